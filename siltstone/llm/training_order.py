"""Training-order materialisation: token ids in fixed-stride shards.

Texts become one stream of ids per task, cut into sequences of ``WINDOW`` ids,
which are stored as they are made, so texts are tokenised once. The counts of
the tasks give every sequence its number below n, the count of all. A keyed
Feistel network on the next even power of two, walked along its cycles until it
lands below n, permutes these numbers: the image is the sequence's global slot.

A shard is a range of slots of one length (the last one may be shorter), so
sequences are partitioned by slot, sorted by it and written as one file of
records with a fixed stride: the ids as little-endian 16-bit (or 32-bit)
numbers and one closing byte. Shard and byte of a slot follow from its number:
``slot // shard_records`` and ``slot % shard_records * stride``. So a reader at
any slot seeks once and reads on, and a run resumes at the slot where it stopped.

The order depends on the key and on how the input is split into tasks, which
the files and the session's settings fix. Files go through Spark's own writer,
so any store that Spark writes to will do, with its commit protocol and retries.

Edge cases: null and empty texts give the end id alone; the last sequence of a
task is filled with the end id; repeated rows are repeated; ids that don't fit
the width are an error; an empty table gives no shard and an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import tokens
from siltstone.llm.common import Scratch, map_batches, text_of

WINDOW = 2048
#: Least size of a shard, and most shards, beyond which they grow.
SHARD_BYTES = 16 << 20
MOST_SHARDS = 20_000
KEY = 0x5EED
ROUNDS = 6


def stride_of(window: int, width: int) -> int:
    return window * width + 1


def feistel(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A permutation of range(size), at the given indices."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for k in keys:
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & low)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while len(wide := np.flatnonzero(out >= np.uint64(size))):
        out[wide] = once(out[wide])
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str | None, window: int, width: int) -> DataFrame:
    """task, place (there, from 0), n_tokens and data (ids) of each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 4 * window
        end = np.array([tokens.END_ID], "<u4").tobytes()
        rows: list[tuple[int, bytes]] = []

        def record(data: bytes) -> bytes:
            ids = np.frombuffer(data, "<u4")
            if int(ids.max()) >> 8 * width:
                raise ValueError(f"id {ids.max()} doesn't fit {width} bytes")
            return ids.astype(f"<u{width}").tobytes()

        def told() -> pa.RecordBatch:
            n = len(rows)
            count, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.arange(made - n, made, dtype=np.int64)), pa.array(count, pa.int32()), pa.array(data, pa.binary())], ["task", "place", "n_tokens", "data"])

        held, waiting = [], 0
        for _, data in tokens.encoded(batches, path or tokens.default_path()):
            held.append(data)
            waiting += len(data)
            if waiting >= size:
                stream, full = b"".join(held), waiting // size
                rows += [(window, record(stream[i * size : (i + 1) * size])) for i in range(full)]
                made += full
                held, waiting = [stream[full * size :]], waiting - full * size
            if len(rows) >= 500:
                yield told()
                rows = []
        if waiting:
            data = b"".join(held)
            rows.append((len(data) // 4, record(data + end * (window - len(data) // 4))))
            made += 1
        if rows:
            yield told()

    return map_batches(docs.select("doc_id", text_of().alias("text")), run, "task int, place long, n_tokens int, data binary")


def slotted(made: DataFrame, n: int, shard_records: int, key: int) -> DataFrame:
    """shard, slot and data (compressed ids) of n stored sequences."""
    counts = made.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    # a row of two numbers for each task that read the input: broadcast
    rows = made.join(F.broadcast(before), "task").select((F.col("before") + F.col("place")).alias("number"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                number, data = (c.slice(at, 500) for c in batch.columns)
                slot = feistel(number.to_numpy(), n, key)
                yield pa.RecordBatch.from_arrays([pa.array((slot // shard_records).astype(np.int32)), pa.array(slot), pa.array([press(x) for x in data.to_pylist()], pa.binary())], ["shard", "slot", "data"])

    return map_batches(rows, run, "shard int, slot long, data binary")


def materialise(docs: DataFrame, place: str, path: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, key: int = KEY, width: int = 2) -> dict:
    """Writes the shards and their manifest below ``place`` and returns what describes them, which is written beside them."""
    spark = docs.sparkSession
    s = Scratch(spark, "sequences")
    made = s.save(sequences(docs, path, window, width))
    stride = stride_of(window, width)
    n = made.count()
    shard_records = max(1, shard_bytes // stride, -(-n // MOST_SHARDS))
    shards = -(-n // shard_records)
    about = {"sequences": n, "shards": shards, "shard_records": shard_records, "window": window, "width": width, "stride": stride, "key": key}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        open_ = ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                shard, slot, data = (c.slice(at, 500) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([shard, slot, pa.array([open_(x) for x in data.to_pylist()], pa.binary())], ["shard", "slot", "data"])

    if n:
        # a shard to a partition
        ranged = slotted(made, n, shard_records, key).repartitionById(shards, F.col("shard"))
        records_ = map_batches(ranged, run, "shard int, slot long, data binary").sortWithinPartitions("shard", "slot")
        # the cast keeps the bytes as they are, and the text writer writes them and the separator
        records_.select("shard", F.col("data").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(f"{place}/shards")
        # a row per shard; only lengths are read
        first = F.col("shard").cast("long") * shard_records
        found = _files(spark, place).select("shard", first.alias("first"), (F.col("length") / stride).cast("long").alias("records"), F.substring_index("path", "/shards/", -1).alias("file"))
        found.coalesce(1).write.parquet(f"{place}/manifest")
        bad = spark.read.parquet(f"{place}/manifest").filter(F.col("records") != F.least(F.lit(shard_records), n - F.col("first")))
        if not bad.isEmpty():
            raise ValueError(f"shards below {place} don't have the records they should")
    s.drop(made)
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{place}/about")
    return about


def _files(spark: SparkSession, place: str) -> DataFrame | None:
    """The shard files, or None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/shards/shard=*")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        return None
    return spark.read.format("binaryFile").load(f"{place}/shards")


def records(spark: SparkSession, place: str, about: dict, first: int = 0) -> DataFrame:
    """shard, slot, offset and data of the records from slot ``first`` on."""
    files = _files(spark, place)
    if files is None:
        return spark.createDataFrame([], "shard int, slot long, offset long, data binary")
    stride = about["stride"]
    manifest = spark.read.parquet(f"{place}/manifest").filter(F.col("first") + F.col("records") > first)
    each = files.select("shard", "content").join(manifest, "shard").select("shard", "content", "first", F.explode(F.sequence(F.lit(0), (F.col("records") - 1).cast("int"))).alias("i"))
    slot = F.col("first") + F.col("i")
    return each.filter(slot >= first).select("shard", slot.alias("slot"), (F.col("i") * F.lit(stride).cast("long")).alias("offset"), F.substring(F.col("content"), F.col("i") * stride + 1, F.lit(stride - 1)).alias("data"))


def read_from(spark: SparkSession, place: str, about: dict, slot: int, most: int) -> Iterator[np.ndarray]:
    """The ids of at most ``most`` records from a slot on, read one after the other: one seek in each shard."""
    jvm = spark._jvm
    each = about["shard_records"]
    stop = min(slot + most, about["sequences"])
    while slot < stop:
        row = spark.read.parquet(f"{place}/manifest").filter(F.col("shard") == slot // each).first()
        path = jvm.org.apache.hadoop.fs.Path(f"{place}/shards/{row['file']}")
        file = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            file.seek(slot % each * about["stride"])
            for _ in range(slot, min(stop, (slot // each + 1) * each)):
                data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(file, about["stride"]))
                yield np.frombuffer(data[:-1], f"<u{about['width']}")
                slot += 1
        finally:
            file.close()


def training_order(docs: DataFrame) -> DataFrame:
    """One row per record as it stands in its shard: slot, shard, offset, length, ids_crc32."""
    spark = docs.sparkSession
    place = Scratch(spark, "training-order").path
    about = materialise(docs, place)
    return records(spark, place, about).select("slot", "shard", "offset", F.octet_length("data").cast("long").alias("length"), F.crc32("data").alias("ids_crc32"))
