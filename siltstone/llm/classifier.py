"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Tokens are runs of letters and digits, and runs of other characters. Single
tokens, pairs and the number of three-token windows seen before in the text are
hashed into a table of fixed size; a text is the vector of log(1 + count),
scaled to length 1. Weights are learned one text at a time by the
follow-the-regularised-leader rule with a step of its own for each feature, in
a fixed order, so reruns agree. A score is a sparse dot product.

Training reads a bounded sample of labelled rows: ``SAMPLE`` of those with the
smallest hash of doc_id. Their whole texts become feature vectors on the
executors and meet in one task, whose input is bounded by the sample; the
weights are a table of ``2 ** BITS`` numbers at any corpus size. Every text is
scored, in record batches, without a shuffle.

Edge cases: null and empty texts have the bias alone; rows with a null label
aren't trained on, of several labels for a document the lowest counts, and of
several rows with its doc_id one; rows without doc_id count as held out; without labels every score is 0.5; repeated
rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches, text_of

BITS = 18
SAMPLE = 16_000
FOLDS = 5
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 4
BIAS, AGAIN = 0, 1
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places in the table, values)."""
    tokens = _TOKEN.findall(text)
    n = len(tokens)
    if not n:
        return np.array([BIAS]), np.array([1.0])
    h = _mixed(np.fromiter(map(crc32, tokens), np.uint64, n) + np.uint64(1))
    pairs = _mixed(h[:-1] * np.uint64(3) + h[1:])
    places = np.concatenate((h, pairs)) >> np.uint64(64 - BITS)
    places, counts = np.unique(places.astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    threes = pairs[:-1] * np.uint64(5) + h[2:]
    again = (len(threes) - len(np.unique(threes))) / max(1, len(threes))
    some = places > AGAIN
    places, values = places[some], values[some]
    values = values / max(1e-9, float(np.sqrt(values @ values)))
    return np.concatenate(([BIAS, AGAIN], places)), np.concatenate(([1.0, again], values))


class Ftrl:
    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, l1 = self.z[at], L1
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (_logistic(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _logistic(t: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(t, -40, 40))))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        order, label, text = batch.columns
        for at in range(0, batch.num_rows, 500):
            found = [features(t) for t in text.slice(at, 500).cast("binary").to_pylist()]
            places = pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([order.slice(at, 500), label.slice(at, 500), places, values], ["h", "label", "places", "x"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort()
    model = Ftrl()
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            _, label, places, x = rows[i]
            model.learn(np.frombuffer(places, "<i4"), np.frombuffer(x, "<f4").astype(float), float(label))
    yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())], ["weights"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """Weights, as little-endian 32-bit floats."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label")).filter(~held_out())
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    # at most ``sample`` rows of three numbers: broadcast
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows that repeat a doc_id one is learned from, so the sample bounds texts too
    some = some.groupBy("h", "doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("h", "label", "text")
    vectors = map_batches(some, _vectors, "h long, label int, places binary, x binary")
    found = map_batches(vectors.repartition(1), _fit, "weights binary").first()
    return bytes(found[0]) if found else bytes(4 << BITS)


def score(docs: DataFrame, weights: bytes) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, "<f4").astype(float)
        for batch in batches:
            ids, held, text = batch.columns
            scores = []
            for at in range(0, batch.num_rows, 500):
                for t in text.slice(at, 500).cast("binary").to_pylist():
                    places, x = features(t)
                    scores.append(_logistic(w[places] @ x))
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
