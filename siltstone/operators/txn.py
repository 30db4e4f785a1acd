"""Two-phase transactions: allowed steps, and violations found in a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.functions.codec import is_transaction_control

STARTED, PREPARED, COMMITTED, ABORTED = "STARTED", "PREPARED", "COMMITTED", "ABORTED"

#: What a step does in a state: the next state, or the error it raises.
STEPS: dict[tuple[str, str], object] = {
    (STARTED, "ADD"): STARTED,
    (PREPARED, "ADD"): errors.TransactionWrongState,
    (STARTED, "PREPARE"): PREPARED,
    (PREPARED, "PREPARE"): errors.TransactionAlreadyPrepared,
    (STARTED, "COMMIT"): COMMITTED,
    (PREPARED, "COMMIT"): COMMITTED,
    (STARTED, "ABORT"): ABORTED,
    (PREPARED, "ABORT"): ABORTED,
}


def step(txn_id: int, state: str | None, action: str) -> str:
    """The state after an action; raises where the action isn't allowed."""
    if state is None:
        raise errors.TransactionNotFound(txn_id)
    if state == COMMITTED:
        raise errors.TransactionAlreadyCommitted(txn_id)
    if state == ABORTED:
        raise errors.TransactionAlreadyAborted(txn_id)
    after = STEPS[state, action]
    if isinstance(after, str):
        return after
    raise after(txn_id, state) if after is errors.TransactionWrongState else after(txn_id)


def violation(before: Column, op: Column) -> Column:
    """Name of the error that a record raises after the last effective control record ``before``; null if none."""
    control = is_transaction_control(op)
    return (
        F.when(before.isNull() & (op != "BEGIN"), "TransactionNotFound")
        .when(before.isNotNull() & (op == "BEGIN"), "TransactionAlreadyExists")
        .when(before == "COMMIT", "TransactionAlreadyCommitted")
        .when(before == "ABORT", "TransactionAlreadyAborted")
        .when((before == "PREPARE") & (op == "PREPARE"), "TransactionAlreadyPrepared")
        .when((before == "PREPARE") & ~control, "TransactionWrongState")
    )


def violations(log: DataFrame) -> DataFrame:
    """Records that their transaction's state forbids: lsn, txn_id, op, error.

    The state before a record is its last control record, except that nothing
    follows the first COMMIT or ABORT. Windows run within a transaction.
    """
    w = Window.partitionBy("txn_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    control = F.when(is_transaction_control(F.col("op")), F.col("op"))
    ended = F.when(F.col("op").isin("COMMIT", "ABORT"), F.col("op"))
    before = F.coalesce(F.first(ended, ignorenulls=True).over(w), F.last(control, ignorenulls=True).over(w))
    rows = log.filter("txn_id <> 0").withColumn("error", violation(before, F.col("op")))
    return rows.filter("error IS NOT NULL").select("lsn", "txn_id", "op", "error")
