"""Immutable key-sorted Parquet segments, with checksums and a manifest row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.functions import bloom_math
from siltstone.functions.bloom_math import MOST_BITS, MOST_HASHES, MOST_PARTITIONS, BloomParams
from siltstone.functions.codec import entry_checksum, is_text
from siltstone.operators import bloom
from siltstone.schema import FORMAT_VERSION, READ_LIMITS, SEGMENT


def shaped(rows: DataFrame) -> DataFrame:
    """Rows (key, value, lsn[, tombstone]) with a checksum, as a segment has them."""
    rows = rows if "tombstone" in rows.columns else rows.withColumn("tombstone", F.lit(False))
    return rows.select("key", "value", F.col("lsn").cast("long").alias("lsn"), "tombstone", entry_checksum(F.col("key"), F.col("value")).alias("crc"))


def write(rows: DataFrame, path: str, bloom: bool = True) -> None:
    """Range-sorted by key, so that row groups can be skipped by their bounds; with Parquet's own Bloom filter on the key."""
    out = shaped(rows).orderBy("key").write.mode("errorifexists")
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true")
    out.parquet(path)


def read(spark: SparkSession, path: str, format_version: int = FORMAT_VERSION) -> DataFrame:
    if not 1 <= format_version <= FORMAT_VERSION:
        raise errors.DataCorruption(f"segment format {format_version} of {path} isn't known")
    return spark.read.schema(SEGMENT).parquet(path)


def checked(segment: DataFrame) -> DataFrame:
    """The same rows; the value of an entry whose checksum differs is an error where it is read."""
    good = F.coalesce(F.col("crc") == entry_checksum(F.col("key"), F.col("value")), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("checksum differs at key "), F.coalesce("key", F.lit("")))).cast("binary")
    return segment.withColumn("value", F.when(good, F.col("value")).otherwise(bad))


def write_bloom(spark: SparkSession, path: str, params: BloomParams) -> None:
    """The filter of a segment's keys as a table beside it: its bitmaps, each with the filter's parameters."""
    rows = bloom.build(read(spark, path).select("key"), params)
    rows.select("*", F.lit(params.bits).cast("long").alias("m"), F.lit(params.hashes).alias("k"), F.lit(params.partitions).alias("parts")).write.mode("overwrite").parquet(bloom_path(path))


def bloom_path(path: str) -> str:
    return path.rstrip("/") + ".bloom"


def load_bloom(spark: SparkSession, path: str) -> tuple[DataFrame, BloomParams] | None:
    """A segment's filter and its parameters, which must be within bounds; None for a segment without keys."""
    rows = spark.read.parquet(bloom_path(path))
    first = rows.select("m", "k", "parts").first()
    if first is None:
        return None
    if not (1 <= first["m"] <= MOST_BITS and 1 <= first["k"] <= MOST_HASHES and 1 <= first["parts"] <= MOST_PARTITIONS):
        raise errors.DataCorruption(f"filter of {path}")
    return rows.select("part", "bucket", "bits"), BloomParams(0, 0.0, first["m"], first["k"], first["parts"])


def may_contain(spark: SparkSession, paths: list[str], key: str) -> list[str]:
    """Those of the segments whose filters don't rule a key out, by one plan over the few bitmaps that it meets."""
    h1, h2 = bloom_math.hash48_of(key, "a"), bloom_math.hash48_of(key, "b") | 1
    own = bloom_math.hash48_of(key, "p")
    found = spark.range(0).select(F.lit(0).alias("i"), F.lit(True).alias("yes"))
    for i, path in enumerate(paths):
        at = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda n: (F.lit(h1) + n.cast("long") * F.lit(h2)) % F.col("m"))
        hits = F.size(F.filter(at, lambda p: (F.floor(p / bloom.BUCKET_BITS) == F.col("bucket")) & bloom.is_set(F.col("bits"), p % bloom.BUCKET_BITS)))
        rows = spark.read.parquet(bloom_path(path)).filter(F.col("part") == F.lit(own) % F.col("parts"))
        found = found.unionByName(rows.groupBy().agg(F.coalesce(F.sum(hits) == F.max("k"), F.lit(False)).alias("yes")).withColumn("i", F.lit(i)))
    return [paths[r["i"]] for r in found.filter("yes").orderBy("i").collect()]


def index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries (key, storage_ref) of a segment: the file and the row there."""
    rows = spark.read.schema(SEGMENT).parquet(path)
    return rows.select("key", F.struct(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("offset"), F.col("tombstone").alias("is_tombstone")).alias("storage_ref"))


def load(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """key and value of entries (key, storage_ref), read where the references point; deletes have none."""
    files = [r[0] for r in refs.select("storage_ref.file_path").distinct().collect()]  # as many as segments have files
    if not files:
        return refs.select("key", F.lit(None).cast("binary").alias("value"))
    rows = checked(spark.read.schema(SEGMENT).parquet(*files).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    asked = refs.select("key", F.col("storage_ref.file_path").alias("file"), F.col("storage_ref.offset").alias("at"))
    return asked.join(rows.select("key", "file", "at", F.when(~F.col("tombstone"), F.col("value")).alias("value")), ["key", "file", "at"], "left").select("key", "value")


class SegmentReader:
    """A handle of one segment."""

    def __init__(self, spark: SparkSession, path: str, format_version: int = FORMAT_VERSION):
        self.spark, self.file_path, self.rows = spark, path, checked(read(spark, path, format_version))
        at = spark._jvm.org.apache.hadoop.fs.Path(bloom_path(path))
        self.has_bloom_filter = bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))

    def entry_count(self) -> int:
        return self.rows.count()

    def may_contain(self, key: str) -> bool:
        return not self.has_bloom_filter or bool(may_contain(self.spark, [self.file_path], key))

    def may_contain_batch(self, keys: DataFrame) -> DataFrame:
        """Distinct keys with ``may_contain``."""
        found = load_bloom(self.spark, self.file_path) if self.has_bloom_filter else None
        if found is None:
            return keys.select("key").distinct().withColumn("may_contain", F.lit(not self.has_bloom_filter))
        return bloom.probe(keys, *found)

    def get(self, key: str) -> bytes | None:
        """The value of a key, if the filter doesn't rule it out; None for a deleted one."""
        if not self.may_contain(key):
            return None
        row = self.rows.filter((F.col("key") == key) & ~F.col("tombstone")).first()
        return None if row is None or row["value"] is None else bytes(row["value"])


def scrub(segment: DataFrame, limits: dict[str, int] = READ_LIMITS) -> DataFrame:
    """Bad entries: key and the first reason that holds."""
    key, value = F.octet_length("key"), F.octet_length("value")
    reason = (
        F.when(F.col("key").isNull() | (key < limits["key_min"]), "key too short")
        .when(key > limits["key_max"], "key too long")
        .when(value > limits["value_max"], "value too long")
        .when(~is_text(F.col("key").cast("binary")), "key is not UTF-8")
        .when(~F.coalesce(F.col("crc") == entry_checksum(F.col("key"), F.col("value")), F.lit(False)), "checksum differs")
    )
    return segment.select("key", reason.alias("reason")).filter("reason IS NOT NULL")


def stats(segment: DataFrame) -> DataFrame:
    """entry_count and size_bytes, as the manifest has them."""
    return segment.agg(F.count(F.lit(1)).alias("entry_count"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("size_bytes"), F.max("lsn").alias("lsn"))


def verify(spark: SparkSession, path: str, entry_count: int) -> None:
    """Raises if a segment can't be read, has another number of entries, or a bad entry."""
    try:
        found = read(spark, path)
        n, bad = found.count(), scrub(found, READ_LIMITS | {"key_min": 0}).count()
    except Exception as e:
        raise errors.IntegrityCheckFailed(path) from e
    if n != entry_count:
        raise errors.IntegrityCheckFailed(path)
    if bad:
        raise errors.DataCorruption(f"{bad} entries of {path}")
