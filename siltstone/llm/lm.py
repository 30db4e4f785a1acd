"""LM scoring with Brown class-based n-grams.

Exchange clustering assigns words to classes: a word is moved to the class that
most raises the likelihood of the class bigrams, again and again. It is done in
two steps. First the driver moves units until none moves: the frequent words
(each at least one token in ``RARE`` of the corpus, so at most ``RARE`` of them)
and ``SHAPES`` sets of rarer words alike in ending and length, a start for the
others. The matrix of unit bigrams has a bounded size at any corpus size. Then
every other training word, down to those that occur once, is moved by its own
counts before and after its neighbours' classes: one parallel sweep in which the
words see the classes of the first step. Words without training tokens have no
counts and keep the class of their set. A token's probability is the transition
between classes times the emission of the word from its class, interpolated
with the add-one unigram.

Counts cover every training token. Each task reads its documents into blocks
with a vocabulary of bounded size, and tells per block: the documents as local
word numbers, the vocabulary with counts and neighbouring units, and the unit
bigrams. A word's neighbours are told as classes, so its row has a bounded size,
and a task adds up the rows of a word, one per block, as they come: it holds one
vector and where the answers go, never the rows. Classes and counts go back to
the blocks, where class bigrams are counted and documents coded for scoring.
Texts themselves never move.

Edge cases: null and empty texts have the end token alone; rows without doc_id
are held out; without training documents V and N are 0 and every score is the
base's; repeated rows are counted and scored one by one; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, map_batches, shuffle_partitions, text_of

FOLDS, HELD = 7, 2
RARE = 2000
FINER = 8
SHAPES = 256
CLASSES = 48
SWEEPS = 12
#: Weight of the class model against the unigram, and of the class unigram in a transition.
MIX, PRIOR = 0.8, 5.0
BLOCK_WORDS = 300_000
BLOCK_TOKENS = 4_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, list[bytes]]]:
    for batch in batches:
        ids, held, text = batch.columns
        for at in range(0, batch.num_rows, 200):
            some = text.slice(at, 200).cast("binary").to_pylist()
            for i, h, t in zip(ids.slice(at, 200).to_pylist(), held.slice(at, 200).to_pylist(), some, strict=True):
                yield i, h, t.lower().split()  # of bytes: only A-Z change, and only the six separators split


def frequent_words(docs: DataFrame, rare: int = RARE) -> list[bytes]:
    """Words of at least one training token in ``rare``, by count.

    Candidates come from stretches of the tasks, which tell the words of at
    least one token in rare * FINER there. What a frequent word has in stretches
    that don't tell it is less than 1 / FINER of the limit, so at most
    rare * FINER / (FINER - 1) words can be frequent; these are counted anew.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = Counter(), 0
        for _, held, words in _texts(batches):
            if held:
                continue
            count.update(words)
            total += len(words)
            if total >= BLOCK_TOKENS or len(count) >= BLOCK_WORDS:
                yield told(count, total)
                count, total = Counter(), 0
        yield told(count, total)

    def told(count: Counter, total: int) -> pa.RecordBatch:
        some = [(w, n) for w, n in count.items() if n * rare * FINER >= total]
        return pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in some)], pa.binary()), pa.array([total, *(n for _, n in some)], pa.int64())], ["word", "n"])

    sums = map_batches(_rows(docs), stretches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    s = Scratch(docs.sparkSession, "frequent")
    sums = s.save(sums)
    total = sums.filter("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    likely = sums.filter((F.col("n") * (rare * FINER) >= total * (FINER - 1)) & F.col("word").isNotNull())
    known = {bytes(r["word"]) for r in likely.select("word").collect()}
    s.drop(sums)

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for _, held, words in _texts(batches):
            if not held:
                count.update(filter(known.__contains__, words))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    counts = map_batches(_rows(docs), recount, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.filter(F.col("n") * rare >= total).orderBy(F.desc("n"), "word").collect()]


def shape(word: bytes) -> int:
    """Which of the sets of rarer words a word belongs to."""
    first = word[:1]
    kind = b"a" if first.isalpha() else b"0" if first.isdigit() else b"." if first < b"\x80" else b"u"
    return crc32(b"%d %b " % (min(len(word), 15) // 4, kind) + word[-2:]) % SHAPES


_TABLE = "kind int, blk long, doc_id long, held_out boolean, tokens binary, lid int, word binary, n long, unit int, near binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("blk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("lid", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("unit", pa.int32()), ("near", pa.binary())])
DOC, WORD, PAIR = 0, 1, 2
#: A neighbour is 2 * unit, plus 1 if it follows, above this many bits for how often; larger counts take several.
NEAR_BITS = 18
#: The same for neighbours told as classes.
TOLD_BITS = 24
PART_WORDS = 40_000
_CLOSED = np.array([-1], np.int32)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _FIELDS], schema=_FIELDS)


def neighbours(joined: np.ndarray, of: np.ndarray, at: np.ndarray, end: int, first: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries): entries[edges[i] : edges[i + 1]] are the units before and after local word first + i, with counts.

    ``joined`` has the local words of documents, each closed by -1, ``of`` their units, ``at`` the places of the words asked for.
    """
    wide = 2 * (end + 1)
    word = (joined[at].astype(np.int64) - first) * wide
    before, after = np.where(at > 0, of[at - 1], end), of[at + 1]
    key = np.concatenate((word + 2 * before, word + 2 * after + 1))
    key.sort()
    first_of = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first_of, append=len(key))
    word, code = np.divmod(key[first_of], wide)
    return entries_with_counts(word, code, n, NEAR_BITS, words)


def entries_with_counts(row: np.ndarray, code: np.ndarray, n: np.ndarray, bits: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of codes with counts above ``bits`` bits, as many entries as a count needs; rows ascend."""
    most = (1 << bits) - 1
    parts = -(-n // most)
    last = np.cumsum(parts) - 1
    entries = np.repeat(code << bits, parts) + most
    entries[last] += n - parts * most
    return np.searchsorted(np.repeat(row, parts), np.arange(rows + 1)), entries.astype(np.int32)


def blocks(docs: DataFrame, frequent: list[bytes]) -> DataFrame:
    """Rows of three kinds: documents, words of a block, and unit bigrams (``blk`` is then first * units + second)."""
    units = len(frequent) + SHAPES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3).compress
        known = {w: i for i, w in enumerate(frequent)}
        end = units - 1
        block = TaskContext.get().partitionId() << 24
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        training: list[np.ndarray] = []
        told: list[tuple] = []
        size = 0

        def documents() -> pa.RecordBatch:
            ids, held, data = zip(*told, strict=True)
            return _batch(kind=pa.array(np.full(len(ids), DOC, np.int32)), blk=pa.array(np.full(len(ids), block)), doc_id=pa.array(ids, pa.int64()), held_out=pa.array(held, pa.bool_()), tokens=pa.array(data, pa.binary()))

        def vocabulary() -> Iterator[pa.RecordBatch]:
            words = list(number)
            unit = np.fromiter((known[w] if w in known else len(known) + shape(w) for w in words), np.int32, len(words))
            joined = np.concatenate([np.zeros(0, np.int32), *(x for t in training for x in (t, _CLOSED))])
            training.clear()
            count = np.bincount(joined[joined >= 0], minlength=len(words))
            of = np.append(unit, np.int32(end))[joined]
            # a part of the words at a time, so that the keys of their neighbours stay few
            for at in range(0, len(words), PART_WORDS):
                part = slice(at, at + PART_WORDS)
                n = len(words[part])
                edge, entries = neighbours(joined, of, np.flatnonzero((joined >= at) & (joined < at + n) & (of >= len(known))), end, at, n)
                near = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * edge).astype(np.int32)), pa.py_buffer(entries)])
                yield _batch(kind=pa.array(np.full(n, WORD, np.int32)), blk=pa.array(np.full(n, block)), lid=pa.array(np.arange(at, at + n, dtype=np.int32)), word=pa.array(words[part], pa.binary()), n=pa.array(count[part]), unit=pa.array(unit[part]), near=near)
            if len(joined):
                code, n = np.unique(np.concatenate((np.array([end], np.int32), of[:-1])) * np.int32(units) + of, return_counts=True)
                yield _batch(kind=pa.array(np.full(len(code), PAIR, np.int32)), blk=pa.array(code), n=pa.array(n))

        for doc_id, held, words in _texts(batches):
            ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
            told.append((doc_id, held, press(ids.tobytes())))
            size += len(ids)
            if not held:
                training.append(ids)
            if len(told) >= 2000:
                yield documents()
                told = []
            if len(number) >= BLOCK_WORDS or size >= BLOCK_TOKENS:
                if told:
                    yield documents()
                yield from vocabulary()
                block, told, training, size = block + 1, [], [], 0
                number.clear()
        if told:
            yield documents()
        yield from vocabulary()

    return map_batches(_rows(docs), run, _TABLE)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit from the matrix of unit bigrams; the last unit, the end, has a class of its own.

    The criterion is the sum of f(n) over class bigrams less that over class
    counts as first and as second, f(n) = n log n.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    pairs = pairs.astype(float)
    u = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    order = order[order != u - 1]
    of = np.full(u, classes)
    of[order] = np.arange(len(order)) % classes
    one = np.eye(classes + 1)
    right, left = pairs @ one[of], pairs.T @ one[of]
    n = one[of].T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            was, r, l, own = of[w], right[w], left[w], pairs[w, w]
            r, l = r - own * one[was], l - own * one[was]  # to and from the other units
            n[was] -= r
            n[:, was] -= l
            n[was, was] -= own
            gain = (f(n + r) - f(n)).sum(1) + (f(n + l[:, None]) - f(n)).sum(0)
            d = np.diag(n)
            gain += f(d + r + l + own) - f(d + r) - f(d + l) + f(d)
            for total, more in ((n.sum(1), r.sum() + own), (n.sum(0), l.sum() + own)):
                gain -= f(total + more) - f(total)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[was] + 1e-9:
                best = was
            n[best] += r
            n[:, best] += l
            n[best, best] += own
            if best != was:
                moved += 1
                of[w] = best
                right[:, was] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, was] -= pairs[w]
                left[:, best] += pairs[w]
        if not moved:
            break
    return of


def better_classes(group: np.ndarray, near: np.ndarray, n: np.ndarray, was: np.ndarray, total: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Class of each word that makes its neighbours' classes likeliest, its own counts left out.

    Word ``group`` (ascending) has ``n`` times the neighbour ``near``: a class, or ``len(pairs)`` plus
    one that follows. ``was`` and ``total`` are the words' classes and counts, ``pairs`` the class
    bigrams with the words in these classes. To first order this is the gain of ``exchange``; as all
    words move at once, chances are smoothed by ``PRIOR``, or each of them would fill the least class.
    """
    k = len(pairs) - 1
    cell = np.concatenate((pairs[:, :k], pairs[:k].T)).astype(float)
    own = pairs.sum(0)[:k].astype(float)
    smooth = np.concatenate((pairs.sum(1), pairs.sum(0))) + 1.0
    smooth *= PRIOR / smooth[: k + 1].sum()
    chance = np.log((cell + smooth[:, None]) / (own + PRIOR))
    best = was.copy()
    for at in range(0, len(was), 500):
        part = slice(*np.searchsorted(group, (at, at + 500)))
        if part.start == part.stop:
            continue
        g, x, r = group[part], near[part], n[part].astype(float)
        gain = chance[x] * r[:, None]
        here = was[g]
        gain[np.arange(len(g)), here] = r * np.log((np.maximum(cell[x, here] - r, 0) + smooth[x]) / (np.maximum(own[here] - total[g], 0) + PRIOR))
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        gain, some = np.add.reduceat(gain, starts), g[starts]
        to, row = gain.argmax(1), np.arange(len(some))
        best[some] = np.where(gain[row, to] > gain[row, was[some]] + 1e-9, to, was[some])
    return best


def word_classes(words: DataFrame, of: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """blk, lid, n over all blocks, cls, and first (once for each word), from the rows of kind WORD and the units' classes and bigrams."""
    one = np.eye(CLASSES + 1)[of]
    pairs = one.T @ pairs @ one
    wide = 2 * (CLASSES + 1)

    def entries_of(near: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(edges, entries): entries[edges[i] : edges[i + 1]] are those of row i."""
        edge = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1]
        entries = np.frombuffer(near.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]].view(np.int32)
        return (edge - edge[0]) // 4, entries

    def as_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            edge, entries = entries_of(batch.column(5).cast(pa.binary()))
            code = entries >> NEAR_BITS
            key = np.repeat(np.arange(size) * wide, np.diff(edge)) + (code & 1) * (CLASSES + 1) + of[code >> 1]
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, entries & ((1 << NEAR_BITS) - 1), len(key)).astype(np.int64)
            edge, entries = entries_with_counts(key // wide, key % wide, n, TOLD_BITS, size)
            near = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((4 * edge).astype(np.int32)), pa.py_buffer(entries)])
            was = pa.array(of[batch.column(4).to_numpy()].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], was, near], ["word", "blk", "lid", "n", "was", "near"])

    def told(blk: np.ndarray, lid: np.ndarray, starts: np.ndarray, total: np.ndarray, was: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lengths = np.diff(starts, append=len(blk))
        cls = better_classes(key // wide, key % wide, n, was, total, pairs)
        first = np.zeros(len(blk), bool)
        first[starts] = True
        columns = [blk, lid, np.repeat(total, lengths), np.repeat(cls, lengths).astype(np.int32), first]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["blk", "lid", "n", "cls", "first"])

    def summed(rows: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(total, was, key, n) of the words that start there."""
        edge, entries = entries_of(rows.column(5).cast(pa.binary()))
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=rows.num_rows))
        key = np.repeat(group, np.diff(edge)) * wide + (entries >> TOLD_BITS)
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, entries & ((1 << TOLD_BITS) - 1), len(key))
        return np.add.reduceat(rows.column(3).to_numpy(), starts), rows.column(4).to_numpy()[starts], key, n

    class Open:
        """The word that the next batch may go on with: its sums, and where the answer goes."""

        def __init__(self, word: bytes):
            self.word, self.places, self.total, self.near = word, [], 0, np.zeros(wide)

        def add(self, rows: pa.RecordBatch) -> None:
            total, was, key, n = summed(rows, np.zeros(1, np.int64))
            self.places.append((rows.column(1).to_numpy(), rows.column(2).to_numpy()))
            self.total, self.was = self.total + total, was
            self.near[key] += n

        def told(self) -> pa.RecordBatch:
            blk, lid = (np.concatenate(x) for x in zip(*self.places, strict=True))
            key = np.flatnonzero(self.near)
            return told(blk, lid, np.zeros(1, np.int64), self.total, self.was, key, self.near[key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0)
            starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
            at = 0
            if open_ is not None and word[0].as_py() == open_.word:
                open_.add(batch.slice(0, starts[1] if len(starts) > 1 else batch.num_rows))
                at = 1
            if at == len(starts):
                continue
            if open_ is not None:
                yield open_.told()
            middle = batch.slice(starts[at], starts[-1] - starts[at])
            if middle.num_rows:
                some = starts[at:-1] - starts[at]
                yield told(middle.column(1).to_numpy(), middle.column(2).to_numpy(), some, *summed(middle, some))
            open_ = Open(word[int(starts[-1])].as_py())
            open_.add(batch.slice(starts[-1]))
        if open_ is not None:
            yield open_.told()

    rows = map_batches(words.select("word", "blk", "lid", "n", "unit", "near"), as_classes, "word binary, blk long, lid int, n long, was int, near binary")
    rows = rows.repartition(shuffle_partitions(words.sparkSession), "word").sortWithinPartitions("word", "blk")
    return map_batches(rows, run, "blk long, lid int, n long, cls int, first boolean")


class Model(NamedTuple):
    frequent: list[bytes]
    class_of: np.ndarray
    transition: np.ndarray
    room: np.ndarray
    tokens: int
    types: int
    ends: int


def fit(pairs: np.ndarray, types_of_unit: np.ndarray, frequent: list[bytes], classes: int = CLASSES, of: np.ndarray | None = None) -> Model:
    """From the unit bigrams, the number of distinct training words of each unit, and the units' classes, which are found if not given."""
    of = exchange(pairs, classes) if of is None else of
    one = np.eye(classes + 1)[of]
    n = one.T @ pairs @ one
    second = n.sum(0)
    chance = (second + 1) / (second.sum() + len(second))
    transition = (n + PRIOR * chance) / (n.sum(1, keepdims=True) + PRIOR)
    ends = int(pairs[:, -1].sum())
    return Model(frequent, of, transition, second + one.T @ types_of_unit + 1, int(pairs.sum()), int(types_of_unit.sum()) + (ends > 0), ends)


def score_tokens(model: Model, count: np.ndarray, unit: np.ndarray) -> tuple[int, float, float]:
    """(known tokens, base score, score) of a text from the counts and units of its words; the end is added."""
    count = np.append(count, model.ends)
    of = model.class_of[np.append(unit, len(model.class_of) - 1)]
    base = (count + 1) / (model.tokens + model.types + 1)
    step = model.transition[np.concatenate((of[-1:], of[:-1])), of]
    emission = (count + 1) / model.room[of]
    emission[-1] = 1.0
    mixed = MIX * step * emission + (1 - MIX) * base if model.tokens else base
    return int((count > 0).sum()), float(np.log10(base).sum()), float(np.log10(mixed).sum())


def score(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    s = Scratch(spark, "lm")
    frequent = frequent_words(docs, rare)
    table = s.save(blocks(docs, frequent), by="kind")
    units = len(frequent) + SHAPES + 1
    # at most units * units rows, a bound that doesn't depend on the corpus
    found = table.filter(F.col("kind") == PAIR).groupBy("blk").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(units * units, np.int64)
    pairs[found["blk"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    pairs = pairs.reshape(units, units)
    words = s.save(word_classes(table.filter(F.col("kind") == WORD), exchange(pairs), pairs))
    types = np.zeros(CLASSES + 1, np.int64)
    for r in words.filter("first AND n > 0").groupBy("cls").count().collect():
        types[r["cls"]] = r["count"]

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        from zstandard import ZstdCompressor, ZstdDecompressor

        size = right.num_rows
        count, cls = np.zeros(size, np.int64), np.zeros(size, np.uint8)
        at = right["lid"].to_numpy()
        count[at], cls[at] = right["n"].to_numpy(), right["cls"].to_numpy()
        open_, press = ZstdDecompressor().decompress, ZstdCompressor(level=3).compress
        n = np.zeros((CLASSES + 1) ** 2, np.int64)
        data = []
        for tokens, held in zip(left["tokens"].to_pylist(), left["held_out"].to_pylist(), strict=True):
            ids = np.frombuffer(open_(tokens), np.int32)
            of = cls[ids]
            data.append(press(of.tobytes() + count[ids].view(np.uint8).reshape(-1, 8).T.tobytes()))
            if not held:
                to = np.append(of, np.uint8(CLASSES)).astype(np.int64)
                n += np.bincount(np.roll(to, 1) * (CLASSES + 1) + to, minlength=len(n))
        pair = np.flatnonzero(n)
        docs = pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "data": pa.array(data, pa.binary())})
        return pa.concat_tables([docs, pa.table({"pair": pa.array(pair.astype(np.int32)), "n": pa.array(n[pair])})], promote_options="default")

    texts = table.filter(F.col("kind") == DOC).select("blk", "doc_id", "held_out", "tokens")
    coded = s.save(texts.groupBy("blk").cogroup(words.select("blk", "lid", "n", "cls").groupBy("blk")).applyInArrow(code, "doc_id long, held_out boolean, data binary, pair int, n long"))
    s.drop(table, words)
    n = np.zeros((CLASSES + 1) ** 2, np.int64)
    for r in coded.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        n[r["pair"]] = r["n"]
    model = fit(n.reshape(CLASSES + 1, -1), types, [], of=np.arange(CLASSES + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        open_ = ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for data in batch.column(2):
                both = np.frombuffer(open_(data.as_py()), np.uint8).reshape(9, -1)
                count = np.ascontiguousarray(both[1:].T).view(np.int64).ravel()
                out.append((len(count) + 1, *score_tokens(model, count, both[0]), model.tokens))
            if out:
                size, known, base, mixed, tokens = zip(*out, strict=True)
                whole = [pa.array(x, pa.int64()) for x in (size, known, tokens)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *whole, pa.array(base, pa.float64()), pa.array(mixed, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = coded.filter("pair IS NULL").select("doc_id", "held_out", "data")
    return map_batches(texts, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
