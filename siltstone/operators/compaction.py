"""Size tiers, and merging of segments by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier_groups(infos: DataFrame, ratio: float, min_group: int, *by: str) -> DataFrame:
    """Groups of similarly sized segments: by..., group, idx, size_bytes.

    In order of size a segment joins the current group while its size is at
    most ``ratio`` times the group's smallest; two empty segments are alike.
    Groups below ``min_group`` are dropped. A fold over the segments of one
    table; there are as many rows as segments, not entries.
    """
    item = F.struct(F.col("size_bytes").cast("double").alias("size"), F.col("idx").cast("long").alias("idx"))
    start = F.array().cast("array<struct<size: double, idx: bigint, low: double>>")

    def more(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        low = F.when((F.size(acc) > 0) & (x["size"] <= ratio * last["low"]), last["low"]).otherwise(x["size"])
        return F.concat(acc, F.array(F.struct(x["size"].alias("size"), x["idx"].alias("idx"), low.alias("low"))))

    folded = infos.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("sorted")).select(*by, F.aggregate("sorted", start, more).alias("rows"))
    # a group starts where its smallest member stands; equal sizes share it
    marked = folded.select(*by, F.explode(F.transform(F.col("rows"), lambda x: F.struct(x.alias("x"), F.size(F.filter(F.col("rows"), lambda y: y["low"] == x["low"])).alias("n"), F.size(F.array_distinct(F.transform(F.filter(F.col("rows"), lambda y: y["low"] < x["low"]), lambda y: y["low"]))).alias("at")))).alias("m"))
    rows = marked.filter(F.col("m.n") >= min_group).select(*by, F.col("m.at").alias("_at"), F.col("m.x.idx").alias("idx"), F.col("m.x.size").cast("long").alias("size_bytes"))
    w = Window.partitionBy(*by).orderBy("_at")
    return rows.select(*by, (F.dense_rank().over(w) - 1).alias("group"), "idx", "size_bytes")


def merge(segments: list[DataFrame], drop_tombstones: bool = False, by: str | None = None) -> DataFrame:
    """One row per key from segments (key, value, tombstone, ...), the greatest ``by`` winning, or by default the latest segment.

    ``drop_tombstones`` is for a merge that covers every older segment.
    """
    rows = segments[0].withColumn("_seq", F.lit(0))
    for i, s in enumerate(segments[1:], 1):
        rows = rows.unionByName(s.withColumn("_seq", F.lit(i)))
    kept = [c for c in segments[0].columns if c != "key"]
    out = rows.groupBy("key").agg(F.max_by(F.struct(*kept), by or "_seq").alias("x")).select("key", "x.*")
    return out.filter(~F.col("tombstone")) if drop_tombstones else out
