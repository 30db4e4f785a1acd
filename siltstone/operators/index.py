"""An ordered index over any orderable key, as an immutable wrapper of a DataFrame.

Writes return a new index, whose plan is the old one with a batch folded in, so
concurrent readers keep what they hold. Batches may have any size; keys are
unique in the index and in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.operators import fold, lookup
from siltstone.schema import KeyRange

LEAST_ORDER = 3
STORAGE_REF = "struct<file_path: string, offset: bigint, is_tombstone: boolean>"


class OrderedIndex:
    """Entries (key, value, storage_ref); value and reference may be null."""

    def __init__(self, entries: DataFrame, order: int = 128):
        if order < LEAST_ORDER:
            raise ValueError(f"order {order}; at least {LEAST_ORDER} is needed")
        self.entries, self.order = entries.select("key", "value", "storage_ref"), order

    @classmethod
    def empty(cls, spark: SparkSession, key: str = "string", value: str = "binary", order: int = 128) -> OrderedIndex:
        return cls(spark.createDataFrame([], f"key {key}, value {value}, storage_ref {STORAGE_REF}"), order)

    def _with(self, entries: DataFrame) -> OrderedIndex:
        return OrderedIndex(entries, self.order)

    def find(self, key: object) -> DataFrame:
        return lookup.get(self.entries, key)

    def find_many(self, keys: DataFrame) -> DataFrame:
        return lookup.multi_get(self.entries, keys)

    def contains(self, keys: DataFrame) -> DataFrame:
        return lookup.contains(self.entries, keys)

    def insert(self, batch: DataFrame) -> OrderedIndex:
        """Upserts rows (key, value[, storage_ref]); a missing or null reference clears the old one."""
        if "storage_ref" not in batch.columns:
            batch = batch.withColumn("storage_ref", F.lit(None).cast(STORAGE_REF))
        rows = self.entries.withColumn("lsn", F.lit(0)).unionByName(batch.select("key", "value", "storage_ref").withColumn("lsn", F.lit(1)))
        return self._with(fold.index_entries(rows))

    def remove(self, keys: DataFrame) -> OrderedIndex:
        """Without the given keys; missing ones are no error."""
        return self._with(self.entries.join(keys.select("key"), "key", "left_anti"))

    def delete(self, key: object) -> OrderedIndex:
        """Without a key, which must be there."""
        if self.find(key).isEmpty():
            raise errors.IndexKeyNotFound
        return self._with(self.entries.filter(F.col("key") != F.lit(key)))

    def range(self, keys: KeyRange = KeyRange()) -> DataFrame:
        return lookup.scan(self.entries, keys)

    def live(self) -> DataFrame:
        """Entries that are no tombstones."""
        return self.entries.filter(~fold.is_tombstone(F.col("value"), F.col("storage_ref")))

    def len(self) -> int:
        return self.entries.count()

    def is_empty(self) -> bool:
        return self.entries.isEmpty()

    def clear(self) -> OrderedIndex:
        return self._with(self.entries.limit(0))
