"""Last-writer-wins folds of a mutation log.

A log is an append-only DataFrame (lsn, op, key, value, id, txn_id, ...). Its
state is the last PUT of each key that no DEL, CLEAR or unfinished transaction
undoes. Everything here is one plan of filters, one semi join and one partially
aggregated groupBy; the last CLEAR is a scalar subquery, whose scan prunes to
the few CLEAR rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.codec import is_transaction_control


def transaction_status(log: DataFrame) -> DataFrame:
    """txn_id, status (of the last control record), began, ended and operations of each transaction."""
    control = is_transaction_control(F.col("op"))
    name = {"BEGIN": "STARTED", "PREPARE": "PREPARED", "COMMIT": "COMMITTED", "ABORT": "ABORTED"}
    last = F.max_by(F.when(control, F.col("op")), F.when(control, F.col("lsn")))
    rows = log.filter("txn_id <> 0").groupBy("txn_id").agg(
        last.alias("last"),
        F.min("lsn").alias("began"),
        F.max(F.when(F.col("op").isin("COMMIT", "ABORT"), F.col("lsn"))).alias("ended"),
        F.count_if(~control).alias("operations"),
    )
    status = F.lit(None).cast("string")
    for op, s in name.items():
        status = F.when(F.col("last") == op, s).otherwise(status)
    return rows.select("txn_id", status.alias("status"), "began", "ended", "operations")


def committed(log: DataFrame) -> DataFrame:
    """Rows without a transaction, and those of committed ones."""
    done = log.filter(F.col("op").isin("COMMIT", "ABORT") & (F.col("txn_id") != 0)).groupBy("txn_id").agg(F.max_by("op", "lsn").alias("last")).filter("last = 'COMMIT'").select("txn_id")
    return log.filter("txn_id = 0").unionByName(log.filter("txn_id <> 0").join(done, "txn_id", "left_semi").select(*log.columns))


def open_at(log: DataFrame, lsn: int | Column) -> DataFrame:
    """Transactions that began by an LSN and did not finish by it."""
    control = F.col("op").isin("COMMIT", "ABORT")
    return log.filter((F.col("txn_id") != 0) & (F.col("lsn") <= lsn)).groupBy("txn_id").agg(F.bool_or(control).alias("done")).filter("NOT done").select("txn_id")


def tail_of(log: DataFrame, lsn: int | Column) -> DataFrame:
    """What a log keeps at a checkpoint: later records, and those of transactions open there."""
    late = log.filter(F.col("lsn") > lsn)
    early = log.filter((F.col("lsn") <= lsn) & (F.col("txn_id") != 0))
    return late.unionByName(early.join(open_at(log, lsn), "txn_id", "left_semi").select(*log.columns))


def upto(log: DataFrame, lsn: int | Column | None) -> DataFrame:
    return log if lsn is None else log.filter(F.col("lsn") <= lsn)


def last_clear(log: DataFrame) -> Column:
    """LSN of the last CLEAR, or -1, as a scalar subquery."""
    return log.filter("op = 'CLEAR'").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("lsn")).scalar()


def after_last_clear(log: DataFrame) -> DataFrame:
    """PUT and DEL rows after the last CLEAR."""
    return log.filter(F.col("op").isin("PUT", "DEL")).filter(F.col("lsn") > last_clear(log))


def last_writes(rows: DataFrame) -> DataFrame:
    """The last row of each key, deletes included: key, value, lsn, op."""
    return rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "lsn").alias("x"), F.max("lsn").alias("lsn")).select("key", "x.value", "lsn", "x.op")


def replay(log: DataFrame, snapshot: DataFrame | None = None, upto_lsn: int | Column | None = None, transactional: bool = True) -> DataFrame:
    """State (key, value, lsn) of a log, over an older snapshot (key, value, lsn) if given.

    Transactions count if they committed by ``upto_lsn``; a CLEAR counts if its
    transaction does, so it is looked for after that filter.
    """
    seen = upto(log, upto_lsn)
    seen = committed(seen) if transactional else seen
    rows = seen.filter(F.col("op").isin("PUT", "DEL")).select("key", "value", "lsn", "op")
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select("key", "value", "lsn", F.lit("PUT").alias("op")))
    rows = rows.filter(F.col("lsn") > last_clear(seen))
    return last_writes(rows).filter("op = 'PUT'").select("key", "value", "lsn")


def old_values(log: DataFrame) -> DataFrame:
    """Each PUT and DEL with the value it replaces: null after a DEL, a CLEAR or nothing.

    The number of CLEARs before a row is its epoch; within a key and epoch the
    previous row is all that matters. Epoch edges are a small sorted list, found
    by a scan of CLEAR rows only.
    """
    clears = log.filter("op = 'CLEAR'").agg(F.sort_array(F.collect_list("lsn")).alias("lsns")).scalar()
    epoch = F.size(F.filter("clears", lambda x: x < F.col("lsn")))
    w = Window.partitionBy("key", "epoch").orderBy("lsn")
    rows = log.filter(F.col("op").isin("PUT", "DEL")).withColumn("clears", clears).withColumn("epoch", epoch)
    return rows.withColumn("old_value", F.when(F.lag("op").over(w) == "PUT", F.lag("value").over(w))).select("lsn", "op", "key", "value", "old_value")


def generations(log: DataFrame) -> DataFrame:
    """Each write with its key's generation, counted from 0, and whether a later one makes it stale."""
    w = Window.partitionBy("key").orderBy("lsn")
    rows = log.filter(F.col("op").isin("PUT", "DEL")).select("lsn", "key", (F.row_number().over(w) - 1).cast("long").alias("generation"), F.lead("lsn").over(w).isNotNull().alias("is_stale"))
    return rows


def is_tombstone(value: Column, storage_ref: Column) -> Column:
    """Of an index entry: what its reference says, else whether it has no value."""
    return F.coalesce(storage_ref["is_tombstone"], value.isNull())


def index_entries(writes: DataFrame) -> DataFrame:
    """Ordered-index view: the last write of a key sets both its value and its storage reference (null clears it)."""
    return writes.groupBy("key").agg(F.max_by(F.struct("value", "storage_ref"), "lsn").alias("x")).select("key", "x.value", "x.storage_ref")
