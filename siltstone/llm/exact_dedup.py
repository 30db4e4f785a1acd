"""Exact dedup by deterministic block naming.

A normalised text is cut into fixed-size blocks. Distinct blocks are sorted and
each gets an integer name that grows with that order; then the names of
adjacent blocks are paired, the distinct pairs sorted and named in turn, until
every document has one name. Two documents have equal names at the same level
exactly if their texts are equal, as each step names distinct values distinctly.

Blocks are sorted by (64-bit hash, content). The text crosses the network once,
to list the distinct contents of each hash after a partial aggregation on the
map side; documents then carry the hash, and only hashes with several contents
(``variants``) are resolved by content. The joins that hand names back have a
plain exchange on each side, so a hot name is split at run time.

Edge cases: null counts as empty, and the empty text is one block. Of equal
texts the smallest doc_id stays, null last; of repeated rows with that doc_id
one stays. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE_RUN, Scratch, columns_of, free_names, shuffle_partitions, text_of

BLOCK_BYTES = 4096


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACE_RUN, " ")


def text_sha(text: str = "text") -> Column:
    return F.sha2(normalised(text), 256)


def _name(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys to integer names that grow with the sort order of the keys."""
    n = shuffle_partitions(keys.sparkSession)
    return keys.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """One row per block: rid, id, sha (with the first block), blocks (how many), idx, h, block."""
    b = F.lit(block_bytes)
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("id"), normalised().cast("binary").alias("bytes"))
    d = d.withColumn("blocks", F.greatest(F.ceil(F.octet_length("bytes") / b), F.lit(1)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("idx"), F.substring(F.col("bytes"), i * b + 1, b).alias("block")))
    d = d.select("rid", "id", "blocks", F.sha2("bytes", 256).alias("sha"), F.explode(cut).alias("x"))
    h = F.xxhash64("x.block")
    if hash_bits < 64:
        h = h.bitwiseAND(F.lit((1 << hash_bits) - 1))
    return d.select("rid", "id", "blocks", F.when(F.col("x.idx") == 0, F.unhex("sha")).alias("sha"), F.col("x.idx").alias("idx"), h.alias("h"), F.col("x.block").alias("block"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> tuple[DataFrame, Scratch]:
    """One row per input row: rid, id, sha, level, name. (level, name) is the identity of the text.

    ``hash_bits`` below 64 makes hashes collide, for tests.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "block-names")
    rows = _blocks(docs, block_bytes, hash_bits)
    per_hash = s.save(rows.groupBy("h", "block").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("variants")))
    shared = per_hash.filter("variants > 1")
    if shared.limit(1).count():
        contents = rows.join(shared.select("h"), "h", "left_semi").select("h", "block").distinct()
        order = s.save(contents.withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1))
        told = rows.join(order, ["h", "block"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
        first = s.save(told.drop("block"))
    else:
        first = s.save(rows.drop("block").withColumn("variant", F.lit(0)))
    names = s.save(_name(per_hash.select("h", F.explode(F.sequence(F.lit(0), (F.col("variants") - 1).cast("int"))).alias("variant")), ["h", "variant"]))
    level = s.save(first.join(names, ["h", "variant"]).select("rid", "id", "blocks", "sha", "idx", "name"))
    s.drop(first, names)
    most = level.agg(F.max("blocks")).first()[0] or 1
    ended = [level.filter("blocks = 1").select("rid", "id", "sha", F.lit(0).alias("level"), "name")]
    step = 0
    while most > 1:
        step += 1
        half = F.shiftright("idx", 1)
        even = F.col("idx").bitwiseAND(F.lit(1)) == 0
        pairs = s.save(
            level.filter("blocks > 1")
            .groupBy("rid", half.alias("idx"))
            .agg(F.max("id").alias("id"), F.max("blocks").alias("blocks"), F.max("sha").alias("sha"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        )
        names = s.save(_name(pairs.select("a", "b").distinct(), ["a", "b"]))
        level = s.save(pairs.join(names, ["a", "b"]).select("rid", "id", F.shiftright(F.col("blocks") + 1, 1).alias("blocks"), "sha", "idx", "name"))
        s.drop(pairs, names)
        ended.append(level.filter("blocks = 1").select("rid", "id", "sha", F.lit(step).alias("level"), "name"))
        most = (most + 1) // 2
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    return out, s


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, s = identities(docs, block_bytes, hash_bits)
    groups = s.save(rows.groupBy("level", "name").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("level", "name", F.col("first.id").alias("keep"), F.col("first.rid").alias("keep_rid"), "size"))
    alone = F.col("size").isNull()
    return rows.join(groups, ["level", "name"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows are found again by (doc_id, hash of the normalised text); of several
    rows alike in both one stays.
    """
    sha, key = free_names(docs, "_dedup_sha", "_dedup_id")
    kept = dedup(docs).filter("kept").select(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(sha))
    kept = Scratch(docs.sparkSession, "kept").save(kept)
    own = docs.withColumn(sha, F.unhex(text_sha())).withColumn(key, F.col("doc_id").cast("long"))
    # the same exchange serves the semi join and the choice of one row
    return own.join(kept, (own[key].eqNullSafe(kept[key])) & (own[sha] == kept[sha]), "left_semi").dropDuplicates([key, sha]).select(*columns_of(docs))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, rid) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""
