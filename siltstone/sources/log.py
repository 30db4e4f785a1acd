"""The mutation log as a table of files: append, read, verify, cut at a checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.functions.codec import record_checksum
from siltstone.operators import fold
from siltstone.schema import LOG
from siltstone.sources.manifest import Manifest


def with_checksum(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", record_checksum(F.col("op"), F.col("key"), F.col("value"), F.col("id"), F.col("txn_id")))


def split_valid(log: DataFrame) -> DataFrame:
    """Rows with ``valid``: whether the checksum is that of the record."""
    crc = record_checksum(F.col("op"), F.col("key"), F.col("value"), F.col("id"), F.col("txn_id"))
    return log.withColumn("valid", F.coalesce(F.col("crc") == crc, F.lit(False)))


def checkpoint_lsn(log: DataFrame, checkpoint_id: int) -> int:
    """LSN of a checkpoint's start; raises where the log has none."""
    row = log.filter((F.col("op") == "CHECKPOINT_START") & (F.col("id") == checkpoint_id)).agg(F.max("lsn")).first()
    if row[0] is None:
        raise errors.CheckpointNotFound
    return row[0]


def tail(log: DataFrame, lsn: int) -> DataFrame:
    """Records after an LSN; the comparison reaches the scan."""
    return log.filter(F.col("lsn") > lsn)


def verified(log: DataFrame) -> DataFrame:
    """The same rows; the value of a record whose checksum differs is an error where it is read.

    The check is part of the value, not a filter: a planner may merge filters and
    put constants of one into another, or test rows that another would drop.
    """
    bad = F.raise_error(F.concat(F.lit(f"{errors.InvalidRecord()}: LSN "), F.col("lsn").cast("string"))).cast("binary")
    return split_valid(log).withColumn("value", F.when(F.col("valid"), F.col("value")).otherwise(bad)).drop("valid")


STREAM = 1_000_000_000


def last_batches(log: DataFrame) -> DataFrame:
    """The last BATCH record of each stream, whose number is ``STREAM`` times the stream's and the batch's."""
    marks = log.filter("op = 'BATCH'")
    last = marks.groupBy(F.floor(F.col("id") / STREAM).alias("stream")).agg(F.max("id").alias("id")).select("id")
    return marks.join(last, "id", "left_semi").select(*log.columns).dropDuplicates(["id"])


def kept_at(log: DataFrame, lsn: int) -> DataFrame:
    """What a log keeps when it is cut: later records, those of transactions open there, and what streams have delivered."""
    rest = fold.tail_of(log, lsn)
    return rest.filter("op <> 'BATCH'").unionByName(last_batches(log))


class Log:
    """A log below a path. An append is one commit of Spark's writer, so a reader sees all of it or nothing.

    The log is a folder, its generation. A cut writes the next generation beside
    it, and one row of the manifest puts that in force: a crash before the row
    leaves the old log as it was, one after it a folder that nobody reads.

    One writer at a time: the first append of an object claims the log with a
    file that only one can create, and an append by an older claim is an error.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.root, self.manifest = spark, path.rstrip("/"), manifest
        self._next: int | None = None
        self._claim: int | None = None
        self.refresh()

    def refresh(self) -> None:
        """Looks up which generation is in force."""
        self.generation = self.manifest.generation() or "g0"

    @property
    def path(self) -> str:
        return f"{self.root}/{self.generation}"

    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self) -> bool:
        fs, path = self._at(self.path)
        return fs.exists(path)

    def read(self) -> DataFrame:
        """Records; the value of one whose checksum differs is an error."""
        return verified(self.raw())

    def raw(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def verify(self) -> None:
        """Raises if a record is damaged."""
        if not split_valid(self.raw()).filter("NOT valid").isEmpty():
            raise errors.InvalidRecord

    def ordered(self) -> DataFrame:
        return self.read().orderBy("lsn")

    def next_lsn(self) -> int:
        """One above all LSNs of the log and of the manifest, so that numbers never start again."""
        if self._next is None:
            self._next = max(self.raw().agg(F.max("lsn")).first()[0] or 0, self.manifest.greatest_lsn()) + 1
        return self._next

    def claim(self) -> None:
        """Makes this object the log's writer, or raises if another one is by now."""
        fs, place = self._at(f"{self.root}/writers")
        last = max([int(f.getPath().getName()) for f in fs.listStatus(place)], default=0) if fs.exists(place) else 0
        if self._claim is None:
            if not fs.createNewFile(self._at(f"{self.root}/writers/{last + 1}")[1]):
                raise errors.LogError(f"another writer claims {self.root}")
            self._claim, self._next = last + 1, None
            self.refresh()
        elif last != self._claim:
            raise errors.LogError(f"another writer has {self.root}")

    def append(self, records: list[tuple]) -> tuple[int, int]:
        """Records (op, key, value, id, txn_id) of the driver; returns their first and last LSN."""
        self.claim()
        first = self.next_lsn()
        rows = [(first + i, *r, None, None) for i, r in enumerate(records)]
        df = self.spark.createDataFrame(rows, LOG).withColumn("ts", F.current_timestamp())
        with_checksum(df).coalesce(1).write.mode("append").parquet(self.path)
        self._next = first + len(rows)
        return first, self._next - 1

    def append_frame(self, rows: DataFrame, op: str | None, txn_id: int = 0, mark: int | None = None) -> tuple[int, int]:
        """Set-based append of rows (key[, value][, op]), in which a key comes once, and of a BATCH record ``mark``.

        The rows of a batch share one LSN, as no two of them are about the same
        key: an LSN orders batches, and nothing has to be sorted or counted.
        """
        self.claim()
        lsn = self.next_lsn()
        null = F.lit(None)

        def record(df: DataFrame, op: Column, key: Column, value: Column, id_: Column) -> DataFrame:
            return df.select(F.lit(lsn).cast("long").alias("lsn"), op.alias("op"), key.cast("string").alias("key"), value.cast("binary").alias("value"), id_.cast("long").alias("id"), F.lit(txn_id).cast("long").alias("txn_id"), F.current_timestamp().alias("ts"))

        df = record(rows, F.lit(op) if op else F.col("op"), F.col("key"), F.col("value") if "value" in rows.columns else null, null)
        if mark is not None:
            df = df.unionByName(record(self.spark.range(1), F.lit("BATCH"), null, null, F.lit(mark)))
        with_checksum(df).write.mode("append").parquet(self.path)
        self._next = lsn + 1
        return lsn, lsn

    def truncate(self, lsn: int) -> None:
        """Drops records up to an LSN, but for what ``kept_at`` says; the new generation is in force with the manifest's row."""
        self.claim()
        self.next_lsn()
        old = self.path
        name = f"g{lsn}-{uuid.uuid4().hex[:8]}"
        kept_at(self.read(), lsn).write.parquet(f"{self.root}/{name}")
        self.manifest.add("LOG", segment_path=name, lsn=lsn)
        self.generation = name
        fs, path = self._at(old)
        fs.delete(path, True)
