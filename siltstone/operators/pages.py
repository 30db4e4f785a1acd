"""Pages of an ordered index: rows with a sorted array ``entries`` of structs with a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import lookup
from siltstone.schema import KeyRange


def assign(rows: DataFrame, page_size: int, column: str = "key", *by: str) -> DataFrame:
    """Leaf and slot of each row in key order, leaves filled to ``page_size``; with ``by``, one index for each group.

    Rows without a key have no place in an index and are left out.
    """
    at = F.col("position") - 1
    out = lookup.ranked(rows.filter(F.col(column).isNotNull()), KeyRange.full(), column, *by)
    return out.withColumn("page", F.floor(at / page_size).cast("long")).withColumn("slot", (at % page_size).cast("long")).drop("position")


def collected(assigned: DataFrame, entry: Column, *by: str) -> DataFrame:
    """Pages of assigned rows: by..., page, entries. An array holds a page, so at most ``page_size`` rows."""
    return assigned.groupBy(*by, "page").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def lower_bound(keys: Column, key: object) -> Column:
    """Number of keys below ``key``: where it stands or would be inserted."""
    return F.size(F.filter(keys, lambda x: x < key))


def insert(entries: Column, entry: Column) -> Column:
    """Entries with one put in, replacing that of the same key."""
    return F.sort_array(F.concat(F.filter(entries, lambda x: x["key"] != entry["key"]), F.array(entry)))


def split(entries: Column, leaf: bool = True, child: str | None = None, values: tuple[str, ...] = ("value",)) -> Column:
    """(left, median, right): cut in the middle.

    A leaf's right half keeps the median; of an inner page the left half's last
    entry is promoted, so it is in neither half. Where an inner page's entries
    have a field ``child``, the promoted entry's child leads the right half,
    under the promoted key and without its ``values``.
    """
    half = F.floor(F.size(entries) / 2).cast("int")
    right = F.slice(entries, half + 1, F.size(entries))
    if leaf:
        left, median = F.slice(entries, F.lit(1), half), F.get(entries, half)["key"]
    else:
        promoted = F.get(entries, half - 1)
        left, median = F.slice(entries, F.lit(1), F.greatest(half - 1, F.lit(0))), promoted["key"]
        if child is not None:
            head = promoted
            for v in values:
                head = head.withField(v, F.when(F.lit(False), promoted[v]))
            right = F.when(promoted[child].isNotNull(), F.concat(F.array(head), right)).otherwise(right)
    return F.struct(left.alias("left"), median.alias("median"), right.alias("right"))


def put(entries: Column, entry: Column, most: int) -> Column:
    """(left, median, right) of a leaf after an insert: split if it has more than ``most`` entries, else whole, with median and right null."""
    after = insert(entries, entry)
    cut = split(after)
    over = F.size(after) > most
    return F.struct(F.when(over, cut["left"]).otherwise(after).alias("left"), F.when(over, cut["median"]).alias("median"), F.when(over, cut["right"]).alias("right"))


def in_range(entries: Column, keys: KeyRange) -> Column:
    return F.filter(entries, lambda x: keys.predicate(x["key"]))
