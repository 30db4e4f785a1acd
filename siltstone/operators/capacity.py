"""Capacity of bounded tables.

``trace`` is the running size of a log; ``admit`` decides insert by insert, as
a refused insert leaves the size as it was. That is sequential within a table
(``by``), and parallel over tables: a table's inserts come sorted, as a stream of
record batches, and what is kept of them is the size of each live key. As every
entry is charged some bytes, that is bounded by the capacity, not by the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from siltstone.functions.codec import entry_size


def trace(log: DataFrame, *by: str) -> DataFrame:
    """Each PUT and DEL with the table's size after it, no insert refused: by..., lsn, delta, size_bytes."""
    size = F.when(F.col("op") == "PUT", entry_size(F.col("key"), F.col("value"))).otherwise(F.lit(0)).cast("long")
    key = Window.partitionBy(*by, "key").orderBy("lsn")
    rows = log.filter(F.col("op").isin("PUT", "DEL")).withColumn("_size", size)
    rows = rows.withColumn("delta", F.col("_size") - F.coalesce(F.lag("_size").over(key), F.lit(0).cast("long")))
    return rows.withColumn("size_bytes", F.sum("delta").over(Window.partitionBy(*by).orderBy("lsn"))).select(*by, "lsn", "delta", "size_bytes")


def admit(puts: DataFrame, capacity: int, *by: str) -> DataFrame:
    """Each insert with ``accepted`` and the size after it: by..., lsn, accepted, size_bytes.

    Accepted if the size, less that of the value it replaces, is at most
    ``capacity``; an insert without key or value is refused.
    """
    rows = puts.select(*by, F.col("lsn").cast("long").alias("lsn"), "key", entry_size(F.col("key"), F.col("value")).alias("size"))
    dealt = rows.repartition(*by) if by else rows.repartition(1)
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total, sizes = None, 0, {}
        for batch in batches:
            of = list(zip(*(batch.column(i).to_pylist() for i in range(width)))) if width else [()] * batch.num_rows
            accepted, after = [], []
            for now, key, size in zip(of, batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()):
                if now != table:
                    table, total, sizes = now, 0, {}
                would = None if size is None else total - sizes.get(key, 0) + size
                fits = would is not None and would <= capacity
                if fits:
                    total, sizes[key] = would, size
                accepted.append(fits)
                after.append(total)
            columns = [batch.column(i) for i in range(width + 1)] + [pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: width + 1], "accepted", "size_bytes"])

    schema = StructType([*rows.schema.fields[: width + 1], StructField("accepted", BooleanType()), StructField("size_bytes", LongType())])
    return dealt.sortWithinPartitions(*by, "lsn", "key", "size").mapInArrow(run, schema)
