"""Shared pieces of the training-data operators: text definitions and scratch tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import scratch_root

#: One run of the separators between words; everything else belongs to a word.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of the input is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, quoted, as a name may hold a dot."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes tables that no later plan reads; those behind a returned
    DataFrame stay, as it is lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        self.count += 1
        place = f"{self.path}/t{self.count}"
        to = df.write.option("compression", "zstd")
        (to.partitionBy(by) if by else to).parquet(place)
        out = self.spark.read.schema(df.schema).parquet(place)
        out._scratch_place = place
        return out

    def drop(self, *tables: DataFrame, table_part: tuple[DataFrame, str] | None = None) -> None:
        """Removes tables, and a partition of one, whose readers have all been written."""
        places = [df._scratch_place for df in tables] + ([f"{table_part[0]._scratch_place}/{table_part[1]}"] if table_part else [])
        for place in places:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where it is not installed."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once a session, as an archive in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    place = f"{scratch_root(spark)}/{package.name}-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    context.addPyFile(place)
    context._siltstone_shipped = True
