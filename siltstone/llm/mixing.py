"""Mixing sources to target weights by hash-threshold histograms.

Each source has a budget of words. Whole multiples of the source are whole
copies; the rest of the budget is met by taking the documents whose hash lies
under a threshold. To find it, words are summed by source and leading bits of
the hash; the first bucket that passes the budget is the boundary, and only its
documents go on to the next bits, until the boundary holds one document (or one
set of rows alike). Documents are then filtered by comparing hashes, unsorted.

The histogram sums are partially aggregated, so a hot source costs no more; the
table of thresholds has a row per source, and whether it is broadcast is left
to the planner's size threshold.

Edge cases: a null source is a source of its own, last in order; a null text
has no words; sources without words have the target 0, so none of their rows is
taken; rows without words are taken as often as their source's whole copies;
rows alike in doc_id and text share a hash and are taken together; an empty
table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, columns_of, free_names, text_of, words_of

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BITS = 12
LEVELS = 5
HASH_BITS = BITS * LEVELS


def row_hash() -> Column:
    """60 bits of an MD5 of doc_id and text, which SQL can name too."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of().cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(level: int) -> Column:
    return F.shiftright("h", HASH_BITS - BITS * level)


def weighted(by_source: DataFrame, weights: tuple[int, ...], s: Scratch) -> DataFrame:
    """Sources with the weight of their place in order, null last.

    A range-partitioned sort numbers them within partitions, and the counts of
    the partitions before, one row each, are added; no task sees all sources.
    """
    order = F.col("source").asc_nulls_last()
    rows = by_source.orderBy(order).withColumn("id", F.monotonically_increasing_id())
    rows = s.save(rows.select("source", "source_size", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("before") + F.col("at")) % len(weights) + 1).cast("int"))
    return rows.join(before, "part").select("source", "source_size", w.alias("weight"))


def source_targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to targets: shares by weight, capped at ``most`` sizes, the excess reshared.

    The fixed point of resharing is a water level: what a weight of one gets.
    It starts as if no source were capped and rises, as what capped sources
    leave is shared by the others, until no further source is drowned; a step is
    one aggregate of a row.
    """
    s = Scratch(by_source.sparkSession, "targets")
    t = s.save(weighted(by_source, weights, s).withColumn("cap", (most * F.col("source_size")).cast("long")))
    level, drowned = 0.0, -1
    while True:
        under = F.col("weight") * F.lit(level) > F.col("cap") if drowned >= 0 else F.lit(False)
        r = t.agg(F.sum("source_size").alias("total"), F.sum(F.when(under, F.col("cap"))).alias("caps"), F.sum(F.when(~under, F.col("weight"))).alias("free"), F.count_if(under).alias("drowned")).first()
        if r["drowned"] == drowned or not r["free"]:
            break
        level, drowned = ((r["total"] or 0) - (r["caps"] or 0)) / r["free"], r["drowned"]
    return t.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def thresholds(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): sizes has doc_id, source, size and h per row; plan has a row per source.

    plan: source, source_size, target, copies (whole ones), shift, boundary and
    lower (the boundary bucket and its least hash), included (whether the
    boundary is taken).
    """
    s = Scratch(docs.sparkSession, "mix")
    sizes = s.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(text_of())).cast("long").alias("size"), row_hash().alias("h")))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = s.save(targets.withColumn("copies", whole).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    rows, found, open_ = sizes, [], plan.select("source", "rest")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        hist = rows.groupBy("source", _prefix(level).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        a, b = hist.alias("a"), open_.alias("b")
        cum = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "bucket", "words", "rows", "rest").withColumn("upto", upto)
        over = cum.filter("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", "words", "rows", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), "bucket").alias("x"))
        edge = s.save(over.select("source", "x.*").withColumn("shift", F.lit(shift)))
        last = shift == 0
        more = edge.filter("rows > 1") if not last else edge.limit(0)
        found.append(edge if last else edge.filter("rows = 1"))
        if last or not more.limit(1).count():
            break
        c, e = rows.withColumn("bucket", _prefix(level)).alias("c"), more.alias("e")
        rows = s.save(c.join(e, F.col("c.source").eqNullSafe(F.col("e.source")) & (F.col("c.bucket") == F.col("e.bucket"))).select("c.source", "c.size", "c.h"))
        open_ = more.select("source", "rest")
    edges = found[0]
    for x in found[1:]:
        edges = edges.unionByName(x)
    edges = edges.select(F.col("source").alias("of"), F.col("bucket").alias("boundary"), "shift", F.expr("shiftleft(bucket, shift)").alias("lower"), (2 * F.col("rest") >= F.col("words")).alias("included"))
    out = plan.join(edges, plan["source"].eqNullSafe(edges["of"]), "left").select("source", "source_size", "target", "copies", "boundary", "shift", "lower", "included")
    return sizes, s.save(out)


def copies_of(h: str = "h", size: str = "size", plan: str = "") -> Column:
    """How often a row with hash ``h`` is taken, beside its source's row of the plan; a row without words is no part of the rest."""
    p = {c: F.col(plan + c) for c in ("copies", "boundary", "shift", "lower", "included")}
    under = (F.col(h) < p["lower"]) | (p["included"] & (F.call_function("shiftright", F.col(h), p["shift"]) == p["boundary"]))
    return p["copies"] + ((F.col(size) > 0) & F.coalesce(under, F.lit(False))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken."""
    sizes, plan = thresholds(docs, weights, most)
    a, b = sizes.alias("a"), plan.alias("b")
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.doc_id", "a.size", "b.source_size", "b.target", (F.col("a.size") * copies_of()).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns."""
    _, plan = thresholds(docs, weights, most)
    of, row, h, size = free_names(docs, "_mix_of", "_mix_plan", "_mix_h", "_mix_size")
    p = plan.select(F.col("source").alias(of), F.struct("copies", "boundary", "shift", "lower", "included").alias(row))
    own = docs.select(*columns_of(docs), row_hash().alias(h), F.size(words_of(text_of())).alias(size))
    joined = own.join(p, F.col("source").cast("string").eqNullSafe(F.col(of)), "left")
    # a row is repeated by an array of nothing that is as long as it is taken
    n = copies_of(h, size, f"{row}.").cast("int")
    return joined.select(*columns_of(docs), F.explode(F.array_repeat(F.lit(0), n)).alias(row)).drop(row)


def sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> str:
    """The mix in SQL, by sorting: sources in order of their cap for a unit of weight are drowned up to the first that isn't."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, {HASH_BITS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {most} * sum(size)::BIGINT AS cap FROM d GROUP BY source),
w AS (SELECT *, {list(weights)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight FROM s),
f AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
  / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT)::DOUBLE AS level, row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT coalesce(arg_min(level, place), 0) AS level FROM f WHERE weight * level <= cap),
t AS (SELECT source, source_size, least(l.level * weight, cap::DOUBLE) AS target FROM f, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
b AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
c AS (SELECT b.source, h, words, p.target - p.copies * p.source_size AS rest, sum(words) OVER (PARTITION BY b.source ORDER BY h) AS upto FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(h) AS boundary, 2 * (arg_min(rest - upto + words, h)) >= arg_min(words, h) AS included FROM c WHERE upto > rest GROUP BY source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (copies + (size > 0 AND coalesce(h < boundary OR included AND h = boundary, false))::BIGINT))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""
