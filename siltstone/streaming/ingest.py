"""Streams of mutations into a keyed table.

Each micro-batch is one commit: its last write of every key is appended under
one LSN. A batch that is run again after a failure is known by its number, kept
in the record, and not appended twice. The processing-time trigger plays the
part of a timer: each batch it starts ends with a flush of a non-empty table. A
flush after each batch that fills the table is the capacity check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.log import STREAM
from siltstone.table import KeyedTable


def last_of_batch(rows: DataFrame) -> DataFrame:
    """key, value and op of the last mutation of each key in a batch (order, op, key, value)."""
    return rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "order").alias("x")).select("key", "x.op", "x.value")


def append_batch(table: KeyedTable, rows: DataFrame, batch_id: int, stream_id: int = 1) -> bool:
    """Appends a batch unless it, or a later one of its stream, was appended before; tells whether it did.

    A batch's rows and the mark with its number are one commit of the log, and
    the last mark of a stream stays when the log is cut.
    """
    mark = stream_id * STREAM + batch_id
    if not table.log.read().filter((F.col("op") == "BATCH") & F.col("id").between(mark, (stream_id + 1) * STREAM - 1)).isEmpty():
        return False
    table.log.append_frame(last_of_batch(rows), None, mark=mark)
    return True


def ingest(stream: DataFrame, table: KeyedTable, checkpoint: str, every: str | None = None, flush_when_full: bool = True) -> StreamingQuery:
    """Starts writing a stream (order, op, key, value) to a table; without ``every`` it ends with the data there is."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        new = append_batch(table, rows, batch_id)
        if every and not table.log.read().filter(F.col("op").isin("PUT", "DEL", "CLEAR")).isEmpty():
            table.flush()  # also if a run before failed between append and flush
        elif new and flush_when_full and table.capacity is not None and table.unflushed_bytes() >= table.capacity:
            table.flush()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(stream: DataFrame) -> DataFrame:
    """Incremental fold of a stream (lsn, op, key, value), for the update and complete output modes."""
    return stream.groupBy("key").agg(F.max_by(F.struct("op", "value"), "lsn").alias("x"), F.max("lsn").alias("lsn")).select("key", "x.op", "x.value", "lsn")
