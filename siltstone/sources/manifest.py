"""The manifest: which segments and checkpoints a table has, as an append-only table of small rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schema import FORMAT_VERSION, MANIFEST


def live_segments(manifest: DataFrame) -> DataFrame:
    """Segments in order, without those that a compaction replaced."""
    replaced = manifest.filter("event = 'SEGMENT'").select(F.explode("replaces").alias("segment_path"))
    return manifest.filter("event = 'SEGMENT'").join(replaced, "segment_path", "left_anti").select(*manifest.columns).orderBy("seq")


def checkpoints(manifest: DataFrame) -> DataFrame:
    """checkpoint_id, status (CREATED or DURABLE), lsn, segment_path."""
    durable = F.max_by("segment_path", "seq").alias("segment_path")
    rows = manifest.filter("checkpoint_id IS NOT NULL").groupBy("checkpoint_id")
    return rows.agg(F.when(F.bool_or(F.col("event") == "DURABLE"), "DURABLE").otherwise("CREATED").alias("status"), F.max("lsn").alias("lsn"), durable, F.min("time").alias("start_time"), F.max(F.when(F.col("event") == "DURABLE", F.col("time"))).alias("end_time"))


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self.path)

    def rows(self) -> list:
        """All rows in order: one for each segment, checkpoint and cut, which the driver plans with."""
        return sorted(self.read().collect(), key=lambda r: r["seq"])

    def next_seq(self) -> int:
        return max((r["seq"] for r in self.rows()), default=0) + 1

    def add(self, event: str, **fields: object) -> int:
        """One row, one commit. Sequence numbers only grow."""
        seq = self.next_seq()
        row = {f.name: None for f in MANIFEST} | {"seq": seq, "event": event, "format_version": FORMAT_VERSION, "time": datetime.datetime.now()} | fields
        self.spark.createDataFrame([tuple(row[f.name] for f in MANIFEST)], MANIFEST).coalesce(1).write.mode("append").parquet(self.path)
        return seq

    def segments(self) -> list:
        """Rows of live segments, in order."""
        some = [r for r in self.rows() if r["event"] == "SEGMENT"]
        replaced = {path for r in some for path in r["replaces"] or ()}
        return [r for r in some if r["segment_path"] not in replaced]

    def generation(self) -> str | None:
        """Name of the log's folder that is in force; None before the first cut."""
        return next((r["segment_path"] for r in reversed(self.rows()) if r["event"] == "LOG"), None)

    def greatest_lsn(self) -> int:
        return max((r["lsn"] or 0 for r in self.rows()), default=0)

    def whole_from(self) -> int:
        """The least LSN whose state can still be told: that of the last cut of the log or of its last flush."""
        return max((r["lsn"] or 0 for r in self.rows() if r["event"] in ("LOG", "SEGMENT")), default=0)
