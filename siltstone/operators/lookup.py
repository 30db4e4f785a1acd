"""Reads of a state: points, batches, ranges and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.codec import entry_size
from siltstone.schema import KeyRange
from siltstone.sources.scratch import stored


def get(state: DataFrame, key: object, column: str = "key") -> DataFrame:
    return state.filter(F.col(column) == F.lit(key))


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Every asked key with its value, null if absent."""
    return keys.select("key").join(state, "key", "left")


def contains(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Asked keys with ``found``: repeated keys of the state don't multiply rows."""
    marks = state.select("key").distinct().withColumn("_hit", F.lit(True))
    return keys.select("key").join(marks, "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("found"))


def scan(state: DataFrame, keys: KeyRange, column: str = "key") -> DataFrame:
    """Rows of a key range in key order; the predicate reaches the scan, so the sort sees the range only."""
    return state.filter(keys.predicate(F.col(column))).orderBy(column)


def ranked(state: DataFrame, keys: KeyRange, column: str = "key", *by: str) -> DataFrame:
    """A range with each row's position in key order, counted from 1; with ``by``, in each group.

    A range-partitioned sort numbers rows within partitions and adds the counts
    of those before; no single task sees all rows, nor all of a group. The
    numbered rows are stored, as a second sort need not cut the partitions at the
    same keys.
    """
    part = state.filter(keys.predicate(F.col(column))).orderBy(*by, column).withColumn("_id", F.monotonically_increasing_id())
    local = part.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id") - F.shiftleft(F.col("_part"), 33))
    local = stored(local.drop("_id"), "ranked")
    counts = local.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    a, b = local.alias("a"), counts.withColumn("_before", earlier - F.col("_first")).alias("b")
    on = F.col("a._part") == F.col("b._part")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).select("a.*", (F.col("_before") + F.col("_at") + 1).alias("position")).drop("_part", "_at")


def length(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("len"), (F.count(F.lit(1)) == 0).alias("is_empty"))


def size_bytes(state: DataFrame, capacity: int | None = None) -> DataFrame:
    """Size by the accounting of entries, and fullness (size at or over the capacity)."""
    size = F.coalesce(F.sum(entry_size(F.col("key"), F.col("value"))), F.lit(0)).cast("long")
    out = state.agg(size.alias("size_bytes"))
    return out if capacity is None else out.withColumn("max_capacity", F.lit(capacity).cast("long")).withColumn("is_full", F.col("size_bytes") >= capacity)
