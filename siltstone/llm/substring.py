"""Substring dedup by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words; a word is removed if a window that
covers it also starts elsewhere. The suffix that starts at a window is routed
by a prefix of variable length: its words up to the end of the window's
minimizer, the five-word gram of least hash in it (the first of several). Equal
windows have equal prefixes, so all suffixes that can meet below depth
``WINDOW`` share a subtree, and the suffixes whose prefix ends in the same gram
occurrence travel as one stretch of words. Grams that occur once have no
internal node below them and go no further, which leaves a few per cent of the
text.

A subtree is kept as its sorted suffixes, cut at depth ``WINDOW``: neighbours
that agree to that depth are the leaves of one deep internal node, and their
windows are repeated. Stretches that read alike are combined before they are
shuffled, as a passage that many documents share gives the same ones again and
again.

A subtree of more than ``MOST`` stretches doesn't fit: its suffixes are routed by
longer prefixes. A stretch is cut into two runs of suffixes, by the gram's offset
in the window. The prefixes of a run's suffixes are lengthened to the end of its
first window, so that they end alike in the words that all windows of the run
share, and those route it. Runs that read alike are combined, as stretches are.
This is repeated, with runs half as long, until every part fits. Runs of one
window have prefixes of the full depth, which leave nothing to sort: all suffixes
of one are leaves of one deep node, so they are counted by an aggregate, however
many there are.

Documents with equal word sequences are one text here: if there are several,
each of their windows starts elsewhere. Texts are known by 128 bits of the
SHA-256 of their words.

Edge cases: null, empty and short texts have no window and are kept whole;
overlapping repeats within a text count; repeated rows are copies; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE_RUN, Scratch, map_batches, shuffle_partitions, text_of

WINDOW = 35
GRAM = 5
#: Most stretches, or runs, of a subtree that is built in one piece: some 10 MB.
MOST = 1000
#: Words of a text that are handled at once; windows belong to the part where they start.
PART = 4_000_000
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_text() -> Column:
    """The words of a text joined by one space."""
    return F.trim(F.regexp_replace(text_of(), SPACE_RUN, " "))


def text_key(words: Column) -> Column:
    return F.substring(F.unhex(F.sha2(words, 256)), 1, 16)


def minimizers(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, place): stretches of window starts that have the same gram occurrence, at place, as minimizer."""
    found = []
    for base in range(0, max(0, len(words) - window + 1), PART):
        part = words[base : base + PART + window - 1]
        n = len(part)
        c = np.fromiter(map(crc32, part), np.uint64, n)
        c = (c ^ (c << np.uint64(29))) * _ODD1
        g = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            g = g * _ODD1 + c[k : n - gram + 1 + k]
        g = (g ^ (g >> np.uint64(29))) * _ODD2
        g ^= g >> np.uint64(32)
        place = np.uint64((1 << 24) - 1)
        least = (g & ~place) | np.arange(len(g), dtype=np.uint64)
        size, need = 1, window - gram + 1
        while 2 * size <= need:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < need:
            least = np.minimum(least[: size - need], least[need - size :])
        at = (least & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        found.append((g[at[first]].view(np.int64), first + base, last + base, at[first] + base))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def scan(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows of two kinds: 0 a document (key, sha, doc_id, n), 1 a stretch of a document (key, h, first, last)."""
    fields = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, sha, key, text = (c.slice(at, 500) for c in batch.columns)
                counts, sizes, parts = [], [], []
                for t in text.cast("binary").to_pylist():
                    words = t.split(b" ") if t else []
                    counts.append(len(words))
                    parts.append(minimizers(words, window, gram)[:3])
                    sizes.append(len(parts[-1][0]))
                n = len(ids)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), key, sha, ids, pa.array(counts, pa.int64()), none, none, none], schema=fields)
                h, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
                if len(h):
                    m = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), key.take(pa.array(np.repeat(np.arange(n), sizes))), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(h), pa.array(first), pa.array(last)], schema=fields)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_text().alias("text")).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), text_key(F.col("text")).alias("key"), "text")
    return map_batches(rows, run, "kind int, key binary, sha binary, doc_id long, n long, h long, first long, last long")


def _places(key: str, start: str) -> list[Column]:
    """Aggregates that tell whether a group has more than one place."""
    k = F.xxhash64(key)
    return [F.min(k).alias("k0"), F.max(k).alias("k1"), F.min(start).alias("s0"), F.max(start).alias("s1")]


SEVERAL = "k0 <> k1 OR s0 <> s1"
_STRETCH = "h long, id binary, key binary, first long, words binary"


def stretches(texts: DataFrame, window: int) -> DataFrame:
    """The words of each stretch, from the window that starts first to the end of the one that starts last; id is their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, text, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().split(b" ")
                for x in at:
                    part = b" ".join(words[x["first"] : x["last"] + window])
                    rows.append((x["h"], blake2b(part, digest_size=16).digest(), key, x["first"], part))
                    size += len(part) + 64
                if size > 8_000_000:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["h", "id", "key", "first", "words"])

    return map_batches(texts, run, _STRETCH)


def windows_of(words: bytes, window: int) -> list[bytes]:
    ends = [i for i, c in enumerate(words) if c == 32] + [len(words)]
    starts = [0, *(e + 1 for e in ends)]
    return [words[starts[i] : ends[i + window - 1]] for i in range(len(ends) - window + 1)]


def deep_nodes(suffixes: list[tuple[bytes, object]]) -> list[list[object]]:
    """The leaves below each internal node at full depth: suffixes, cut there, that neighbours in sorted order equal."""
    suffixes.sort(key=itemgetter(0))
    nodes = ([x[1] for x in leaves] for _, leaves in groupby(suffixes, key=itemgetter(0)))
    return [leaves for leaves in nodes if len(leaves) > 1]


_MASK = "route long, id binary, mask long"


def subtrees(rows: DataFrame, window: int) -> DataFrame:
    """route, id and mask: bit i of mask is set if window i of the row is repeated.

    Rows (route, id, words, several) are clustered by route. ``several`` rows have
    several places, so that all their windows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 5000):
                    yield from zip(*(c.slice(at, 5000).to_pylist() for c in batch.columns), strict=True)

        out = []
        for route, group in groupby(flat(), key=itemgetter(0)):
            some = [(id_, windows_of(words, window), several) for _, id_, words, several in group]
            masks = [(1 << len(x[1])) - 1 if x[2] else 0 for x in some]
            if len(some) > 1:
                for leaves in deep_nodes([(w, (i, j)) for i, x in enumerate(some) for j, w in enumerate(x[1])]):
                    for i, j in leaves:
                        masks[i] |= 1 << j
            out += [(route, x[0], m) for x, m in zip(some, masks, strict=True) if m]
            if len(out) > 20_000:
                yield told(out)
                out = []
        if out:
            yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        route, id_, mask = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(id_, pa.binary()), pa.array(mask, pa.int64())], ["route", "id", "mask"])

    clustered = rows.select("route", "id", "words", "several").repartition(shuffle_partitions(rows.sparkSession), "route").sortWithinPartitions("route")
    return map_batches(clustered, run, _MASK)


_RUN = "of long, of_id binary, k int, route long, id binary, words binary, several boolean"


def runs(rows: DataFrame, window: int, gram: int, width: int) -> DataFrame:
    """The rows (route, id, words, several), cut where the gram's offset in the window is a multiple of ``width``.

    A run of (of, of_id) starts at window k of it; its route is the digest of
    the words that all windows with offsets of its block share.
    """
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]

    def cut(of: int, of_id: bytes, text: bytes, several: bool) -> Iterator[tuple]:
        words = text.split(b" ")
        place, last = int(minimizers(words, window, gram)[3][0]), len(words) - window
        for low in range((place - last) // width * width, place + 1, width):
            high = min(low + width - 1, window - gram)
            k, end = max(0, place - high), min(last, place - low)
            shared = b" ".join(words[place - low : place - high + window])
            route = int.from_bytes(blake2b(b"%d %b" % (low, shared), digest_size=8).digest(), "little", signed=True)
            part = b" ".join(words[k : end + window])
            yield of, of_id, k, route, blake2b(part, digest_size=16).digest(), part, several

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = [x for row in zip(*(c.slice(at, 1000).to_pylist() for c in batch.columns), strict=True) for x in cut(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["of", "of_id", "k", "route", "id", "words", "several"])

    return map_batches(rows.select("route", "id", "words", "several"), run, _RUN)


def repeated_windows(rows: DataFrame, window: int, gram: int, s: Scratch, most: int = MOST, width: int = 0) -> DataFrame:
    """route, id and mask of the rows (route, id, words, several) that have repeated windows.

    A route has each sequence of words once, whose windows have the gram at
    offsets of one block of ``width``; 0: at any.
    """
    width = width or window - gram + 1
    if width == 1:
        # prefixes of full depth: each row is the path of a deep node if it has several places, its leaves
        return rows.filter("several").select("route", "id", F.lit(1).cast("long").alias("mask"))
    big = s.save(rows.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("route"))
    found = subtrees(rows.join(big, "route", "left_anti"), window)
    if big.isEmpty():
        return found
    width = 1 << (width - 1).bit_length() - 1
    parts = s.save(runs(rows.join(big, "route", "left_semi"), window, gram, width))
    types = s.save(parts.groupBy("route", "id").agg(F.first("words").alias("words"), (F.bool_or("several") | (F.count(F.lit(1)) > 1)).alias("several")))
    masks = parts.select("of", "of_id", "k", "route", "id").join(repeated_windows(types, window, gram, s, most, width), ["route", "id"])
    masks = masks.groupBy(F.col("of").alias("route"), F.col("of_id").alias("id")).agg(F.bit_or(F.expr("shiftleft(mask, k)")).alias("mask"))
    return found.unionByName(masks)


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, results): rows has doc_id, key, sha and n; results has key, n_removed, kept_sha256 and spans, for texts that lose words.

    spans are the removed stretches of words, as (start, end), or null where all words go.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "substrings")
    table = s.save(scan(docs, window, gram), by="kind")
    rows = table.filter("kind = 0").select("doc_id", "key", "sha", "n")
    copies = s.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).filter(f"rows > 1 AND n >= {window}").select("key", F.col("n").alias("n_removed")))
    marks = table.filter("kind = 1").select("key", "h", "first", "last")
    grams = s.save(marks.groupBy("h").agg(*_places("key", "first")).filter(SEVERAL).select("h"))
    hits = marks.join(grams, "h").groupBy("key").agg(F.collect_set(F.struct("h", "first", "last")).alias("at"))
    text = words_text()
    own = docs.select(text.alias("text")).filter(F.length("text") >= 2 * window - 1).select(text_key(F.col("text")).alias("key"), "text")
    # copies are combined before the shuffle that the join then uses
    texts = s.save(own.dropDuplicates(["key"]).join(hits, "key").select("key", "text", "at"))
    s.drop(grams, table_part=(table, "kind=1"))
    parts = s.save(stretches(texts, window))
    types = s.save(parts.groupBy("h", "id").agg(F.first("words").alias("words"), *_places("key", "first")).select("h", "id", "words", F.expr(SEVERAL).alias("several")))
    masks = repeated_windows(types.withColumnRenamed("h", "route"), window, gram, s, most).withColumnRenamed("route", "h")
    masks = parts.select("h", "id", "key", "first").join(masks, ["h", "id"]).select("key", "first", "mask")
    masks = s.save(masks.join(copies, "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("marks")))
    s.drop(parts, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, t, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = t.encode().split(b" ")
                edge = np.zeros(len(words) + 1, np.int64)
                for x in found:
                    first, mask = x["first"], x["mask"]
                    while mask:
                        low = mask & -mask
                        at = first + low.bit_length() - 1
                        edge[at] += 1
                        edge[at + window] -= 1
                        mask ^= low
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((key, int(gone.sum()), sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]))
            if out:
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), spans), strict=True)], ["key", "n_removed", "kept_sha256", "spans"])

    found = map_batches(texts.select("key", "text").join(masks, "key"), run, "key binary, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>")
    nothing = F.lit(sha256(b"").hexdigest())
    whole = copies.select("key", "n_removed", nothing.alias("kept_sha256"), F.lit(None).cast("array<struct<start: long, end: long>>").alias("spans"))
    return rows, s.save(found.unionByName(whole))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    rows, found = removed(docs, window, gram, most)
    return rows.join(found, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM d, unnest(range(1, len(w) - 33)) t(i)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i FROM win SEMI JOIN again USING (k)),
word AS (SELECT d.r, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) t(j)),
marked AS (SELECT word.r, j, x, coalesce(max(i) OVER (PARTITION BY word.r ORDER BY j), -34) > j - 35 AS gone FROM word LEFT JOIN hit ON word.r = hit.r AND j = i),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY j) FILTER (NOT gone), '') AS t FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
