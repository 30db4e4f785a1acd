"""Bloom filters as tables of bitmaps.

A filter is a DataFrame (part, bucket, bits): bitmaps of 32768 bits, built with
the built-in bitmap aggregates. Building explodes k positions per item and
reduces them on the map side; merging is a bitwise OR per bucket; probing joins
positions to buckets, with the filter's size left to the planner to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.bloom_math import BloomParams, part_of, positions

BUCKET_BITS = 32768


def _placed(items: DataFrame, item: Column, params: BloomParams, *keep: str) -> DataFrame:
    rows = items.select(*keep, part_of(item, params).alias("part"), F.explode(positions(item, params)).alias("pos"))
    return rows.select(*keep, "part", F.floor(F.col("pos") / BUCKET_BITS).alias("bucket"), (F.col("pos") % BUCKET_BITS).alias("bit"))


def build(items: DataFrame, params: BloomParams, item: str = "key") -> DataFrame:
    rows = _placed(items.filter(F.col(item).isNotNull()), F.col(item).cast("string"), params)
    return rows.groupBy("part", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge(a: DataFrame, a_params: BloomParams, b: DataFrame, b_params: BloomParams) -> DataFrame:
    """The union of two filters; their parameters must agree."""
    if (a_params.bits, a_params.hashes, a_params.partitions) != (b_params.bits, b_params.hashes, b_params.partitions):
        raise ValueError("filters of different size or number of hashes can't be merged")
    return a.unionByName(b).groupBy("part", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def clear(filter_: DataFrame) -> DataFrame:
    return filter_.limit(0)


def partition(filter_: DataFrame, part: int) -> DataFrame:
    """One part of a filter."""
    return filter_.filter(F.col("part") == part)


def with_partition(filter_: DataFrame, part: int, rows: DataFrame) -> DataFrame:
    """The filter with one part replaced."""
    return filter_.filter(F.col("part") != part).unionByName(rows.select(F.lit(part).alias("part"), "bucket", "bits"))


def to_bytes(filter_: DataFrame, params: BloomParams) -> DataFrame:
    """part and data of each part: its bits in order, at most 12.5 MB by the bound on a filter's size."""
    buckets = -(-params.bits // BUCKET_BITS)
    held = filter_.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), F.hex("bits")))).alias("held"))
    empty = F.lit("00" * (BUCKET_BITS // 8))
    data = F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("held", i), empty))))
    return held.select("part", F.substring(data, 1, -(-params.bits // 8)).alias("data"))


def from_bytes(stored: DataFrame) -> DataFrame:
    """The filter of rows (part, data)."""
    size = BUCKET_BITS // 8
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / size).cast("int")), lambda i: F.struct(i.cast("long").alias("bucket"), F.substring(F.col("data"), i * size + 1, F.lit(size)).alias("bits")))
    rows = stored.select("part", F.explode(cut).alias("x")).select("part", "x.*")
    return rows.withColumn("bits", F.concat("bits", F.unhex(F.repeat(F.lit("00"), size - F.octet_length("bits")))))


def is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1), F.lit(False))


def probe(items: DataFrame, filter_: DataFrame, params: BloomParams, item: str = "key") -> DataFrame:
    """Distinct asked items with ``may_contain``. An item none of whose buckets exist is told false."""
    rows = _placed(items.select(item).distinct(), F.col(item).cast("string"), params, item)
    hit = rows.join(filter_, ["part", "bucket"], "left")
    return hit.groupBy(item).agg((F.count_if(is_set(F.col("bits"), F.col("bit"))) == params.hashes).alias("may_contain"))


def probe_batch(items: DataFrame, filter_: DataFrame | None, params: BloomParams, item: str = "key", place: str = "place") -> DataFrame:
    """Answers by input position; without a filter everything may be contained."""
    if filter_ is None:
        return items.select(place, item, F.lit(True).alias("may_contain"))
    return items.select(place, item).join(probe(items, filter_, params, item), item)


def any_all(answers: DataFrame) -> DataFrame:
    """Whether any and all of a batch may be contained; any of nothing is false, all of nothing true."""
    return answers.agg(F.coalesce(F.bool_or("may_contain"), F.lit(False)).alias("any_hit"), F.coalesce(F.bool_and("may_contain"), F.lit(True)).alias("all_hit"))


def set_bits(filter_: DataFrame) -> DataFrame:
    """Number of bits set in each part."""
    return filter_.groupBy("part").agg(F.sum(F.bitmap_count("bits")).alias("bits_set"))
