"""Packing documents into fixed-length sequences by best-fit decreasing.

Documents are tokenised, cut into full windows as far as they fill them, and
the remainders are placed, longest first, each into the open window with the
least room that still holds it. A segment tree indexed by remaining room finds
that window in logarithmic time.

Each task packs what it reads, in blocks of bounded memory. What a task leaves
in windows that are less than ``FULL`` per cent full is packed once more, by as
many packers as the sum of these ids asks for, however many tasks there were:
so padding doesn't depend on how the input is split, and little is shuffled.
Windows go to packers by a hash of their number, so no key can be hot. Sequence
ids are the task's partition and a counter.

Edge cases: null and empty texts give one piece with the end id alone; repeated
rows are packed apart; a text of any length is cut into windows as it comes; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import tokens
from siltstone.llm.common import Scratch, map_batches, text_of

WINDOW = 2048
#: A block is packed once its remainders hold so many ids or are so many.
BLOCK_IDS = 6_000_000
BLOCK_PIECES = 60_000
#: A window that holds so many per cent of its room is closed by the task.
FULL = 98
#: Second packers number their sequences from here, beyond those of any first one.
SECOND = 1 << 62

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


class RoomTree:
    """Open windows by remaining room; a node is set if a leaf below it has a window."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of at least ``least``."""
        node = least + self.size
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.open[room].pop()
        if not self.open[room]:
            self.any[node] = 0
            while node > 1 and not self.any[node ^ 1]:
                node >>= 1
                self.any[node] = 0
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """For each length its (window, offset), windows counted from 0."""
    tree, windows = RoomTree(capacity), 0
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, windows = (capacity, windows), windows + 1
        room, window = found
        out[i] = window, capacity - room
        if room > lengths[i]:
            tree.add(room - lengths[i], window)
    return out


def packed(held: list[tuple], window: int, first: int) -> list[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens) as (..., sequence, offset, open); open windows are less than FULL per cent full."""
    places = best_fit_decreasing([len(x[2]) // 4 for x in held], window)
    filled: Counter = Counter()
    for x, (w, _) in zip(held, places, strict=True):
        filled[w] += len(x[2]) // 4
    return [(*x, first + w, offset, 100 * filled[w] < FULL * window) for x, (w, offset) in zip(held, places, strict=True)]


def in_blocks(some: Iterable[tuple], window: int, first: int) -> Iterator[tuple]:
    """Pieces of any number, packed in blocks of bounded size; full ones pass by."""
    held: list[tuple] = []
    size = 0
    for piece in some:
        if len(piece[2]) == 4 * window:
            yield *piece, first, 0, False
            first += 1
            continue
        held.append(piece)
        size += len(piece[2])
        if size >= 4 * BLOCK_IDS or len(held) >= BLOCK_PIECES:
            out = packed(held, window, first)
            yield from out
            first, held, size = max(x[4] for x in out) + 1, [], 0
    yield from packed(held, window, first)


def cut(rows: Iterable[tuple[object, bytes]], window: int = WINDOW) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens): the full windows of each document and what remains."""
    for doc_id, data in rows:
        for at in range(0, len(data), 4 * window):
            yield doc_id, at // 4, data[at : at + 4 * window], len(data) // 4


def _told(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    out: list[tuple] = []
    size = 0
    for doc_id, start, data, total, sequence, offset, open_ in rows:
        out.append((doc_id, start, len(data) // 4, data, total, sequence, offset, open_))
        size += len(data)
        if size > 4_000_000 or len(out) >= 10_000:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit bytes."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = cut(tokens.encoded(batches, path or tokens.default_path()), window)
        yield from _told(in_blocks(rows, window, TaskContext.get().partitionId() << 40))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for at in range(0, b.num_rows, 500) for x in zip(*(c.slice(at, 500).to_pylist() for c in b.columns), strict=True))
        yield from _told(in_blocks(rows, window, SECOND + (TaskContext.get().partitionId() << 40)))

    s = Scratch(docs.sparkSession, "packing")
    made = s.save(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), first, SCHEMA + ", open boolean"))
    left = made.filter("open")
    packers = max(1, -(-left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // BLOCK_IDS))
    again = left.repartition(packers, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "ids", "doc_tokens")
    return made.filter("NOT open").drop("open").unionByName(map_batches(again, second, SCHEMA + ", open boolean").drop("open"))


def digest(packed: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
