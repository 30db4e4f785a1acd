"""Near-duplicates by SimHash, linked through segment bit counts.

Fingerprints: 64 bits over the hashes of three-word shingles, counted with
numpy in record batches. Links: distinct fingerprints at 3 or fewer differing
bits. A fingerprint is embedded as the bit counts of its 32 two-bit segments;
the Manhattan distance of two embeddings never exceeds the number of differing
bits. Counts are kept in unary (0, 01, 11), so that the distance is the number
of differing bits of two codes.

Range join: segments are dealt into some number of groups. At Manhattan distance
3 at most 3 groups differ, so two fingerprints agree in the counts of all others.
The grid has a cell for each choice of all groups but 3 and their counts: with 6
groups a fingerprint lies in 20 cells. Cells are counted first. A cell of at most
``CELL`` fingerprints is joined with itself, the Manhattan bound before the bits.
The fingerprints of fuller cells go to a finer grid, of more groups, where each
of their pairs meets again; so candidates per fingerprint stay bounded however
many there are, and cells grow finer only where they are full. A cell of the
finest grid that is still full is cut into blocks that are joined in tasks of
their own. No pair is lost at any step.

Only distinct fingerprints are joined, so copies cost nothing, and only links
between different fingerprints are made. Components come from alternating
large-star and small-star steps on those links, kept in the shared folder; the
neighbours of a hub stay where they are, and what they look up goes to them.

Edge cases: null, empty and blank texts have the fingerprint 0 and are linked
like any other; texts of one or two words have one shingle; a component of rows
without doc_id has no component_id; repeated rows are one group; an empty table
gives an empty result; only doc_id and text are read, columns of other names
are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, columns_of, free_names, map_batches, text_of

MOST_BITS = 3
SHINGLE = 3
SEED = 42
SEGMENT_BITS = 2
#: Numbers of groups, from the coarsest grid to the finest.
GRIDS = (6, 8, 11, 16)
#: Most fingerprints of a cell that is joined as it is.
CELL = 256
#: Nodes with more neighbours than this, or a 10,000th of all links, are hubs.
HUB = 256
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def group_masks(groups: int) -> list[int]:
    """The bits of each group of segments; 32 segments in groups of nearly equal size."""
    edges = [round(i * 32 / groups) * SEGMENT_BITS for i in range(groups + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def shingle_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: only A-Z change, and only the six separators split
    n = len(words)
    if n <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n - SHINGLE + 1)


def fingerprint_of(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the bits set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    for i, h in enumerate(hashes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text, to find a row again) and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, key, text = batch.columns
            fps = [fingerprint_of([shingle_hashes(t) for t in text.slice(at, 200).cast("binary").to_pylist()]) for at in range(0, batch.num_rows, 200)]
            fp = np.concatenate([*fps, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, key, pa.array(fp)], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    return map_batches(rows, run, "doc_id long, key long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each count in unary."""
    low = F.lit(_LOW)
    next_ = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(next_).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(low), 1))


def cells(fps: DataFrame, groups: int) -> DataFrame:
    """fp, code, choice (of groups) and cell (their counts): a row for each cell that a fingerprint lies in."""
    masks = group_masks(groups)
    each = [F.struct(F.lit(c).alias("choice"), F.col("code").bitwiseAND(F.lit(_signed(sum(masks[g] for g in chosen)))).alias("cell")) for c, chosen in enumerate(combinations(range(groups), groups - MOST_BITS))]
    return fps.select("fp", segment_counts(F.col("fp")).alias("code")).select("fp", "code", F.explode(F.array(*each)).alias("x")).select("fp", "code", "x.*")


def pairs(grid: DataFrame, *by: str, also: Column | None = None) -> DataFrame:
    """Linked pairs a < b of rows that share the columns ``by``, and for which ``also`` holds."""
    a, b = grid.alias("a"), grid.alias("b")
    on = F.col("a.fp") < F.col("b.fp")
    if also is not None:
        on = on & also
    for c in by:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    near = (F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= MOST_BITS) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS)
    return a.join(b, on & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def blocked(grid: DataFrame, full: DataFrame, cell: int) -> DataFrame:
    """Linked pairs within full cells (choice, cell, n), cut into blocks of about ``cell`` rows; each pair of blocks is a key of its own."""
    blocks = F.ceil(F.col("n") / cell).cast("int")
    rows = grid.join(full, ["choice", "cell"]).withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("p"), F.greatest(i, F.col("own")).alias("q")))
    rows = rows.select("fp", "code", "choice", "cell", "own", F.explode(others).alias("x")).select("fp", "code", "choice", "cell", "own", "x.*")
    # rows of one block meet under its own key only
    return pairs(rows, "choice", "cell", "p", "q", also=(F.col("a.own") != F.col("b.own")) | (F.col("a.p") == F.col("a.q")))


def links(fps: DataFrame, s: Scratch, cell: int = CELL, grids: tuple[int, ...] = GRIDS) -> DataFrame:
    """Pairs a < b of the distinct fingerprints of ``fps`` at 3 or fewer differing bits, each at least once."""
    found = []
    for level, n in enumerate(grids):
        grid = cells(fps, n)
        shared = s.save(grid.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        full = shared.filter(F.col("n") > cell)
        found.append(s.save(pairs(grid.join(shared.filter(F.col("n") <= cell), ["choice", "cell"], "left_semi"), "choice", "cell")))
        if full.isEmpty():
            break
        if level + 1 == len(grids):
            found.append(s.save(blocked(grid, full, cell)))
        else:
            fps = s.save(grid.join(full, ["choice", "cell"], "left_semi").select("fp").distinct())
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def components(edges: DataFrame, s: Scratch, hub: int = HUB) -> DataFrame:
    """(node, root) of every node that has an edge, the root being the least of its component.

    Large-star: each node links its larger neighbours to its least neighbour;
    small-star: each node links itself and its smaller neighbours to the least.
    The pair of steps is repeated until the edges are stars.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def looked_up(rows: DataFrame, key: str, least: DataFrame, size: int) -> DataFrame:
        """Rows with ``m`` of their node ``key``. Fewer than 20,000 nodes are hubs, as the degrees sum to twice the edges: broadcast."""
        most = max(hub, size // 10_000)
        hubs = F.broadcast(least.filter(F.col("n") > most).drop("n"))
        some = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(least.filter(F.col("n") <= most).drop("n"), key)
        return rows.join(hubs, key).unionByName(some)

    now = s.save(edges.select("a", "b").distinct())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = s.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = s.save(looked_up(both.filter("v > u"), "u", least, seen[0]).filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        s.drop(least)
        least = s.save(large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")))
        small = looked_up(large, "b", least, seen[0]).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("x")).select("x.*")
        after = s.save(small.filter("a <> b").distinct())
        s.drop(now, large, least)
        now, old, seen = after, seen, mark(after)
        if old == seen:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """(rows, classes): rows has doc_id, key, fp; classes has fp, and the first row of the component as ``first``."""
    s = Scratch(docs.sparkSession, "simhash")
    rows = s.save(fingerprints(docs))
    fps = s.save(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))
    stars = s.save(components(links(fps.select("fp"), s), s))
    linked = stars.join(fps, stars["node"] == fps["fp"]).select("fp", "root", "first")
    least = s.save(linked.groupBy("root").agg(F.min("first").alias("least")))
    moved = stars.join(least, "root").select(F.col("node").alias("fp"), "least")
    classes = s.save(fps.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")))
    return rows, classes, s


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    rows, classes, _ = groups(docs)
    return rows.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns."""
    _, classes, s = groups(docs)
    id_, key = free_names(docs, "_near_id", "_near_key")
    kept = s.save(classes.select(F.col("first.doc_id").alias(id_), F.col("first.key").alias(key)).distinct())
    own = docs.select(*columns_of(docs), F.xxhash64(text_of()).alias(key), F.col("doc_id").cast("long").alias(id_))
    same = own[id_].eqNullSafe(kept[id_]) & (own[key] == kept[key])
    return own.join(kept, same, "left_semi").dropDuplicates([id_, key]).select(*columns_of(docs))
