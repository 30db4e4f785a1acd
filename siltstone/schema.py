"""Schemas of the engine's tables, and bounds of key ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.BinaryType(), False), T.StructField("lsn", T.LongType(), False)])

LOG = T.StructType(
    [
        T.StructField("lsn", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("id", T.LongType()),
        T.StructField("txn_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("crc", T.LongType()),
    ]
)

SEGMENT = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("lsn", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("crc", T.LongType(), False),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("event", T.StringType(), False),
        T.StructField("checkpoint_id", T.LongType()),
        T.StructField("segment_path", T.StringType()),
        T.StructField("replaces", T.ArrayType(T.StringType())),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("entry_count", T.LongType()),
        T.StructField("has_bloom_filter", T.BooleanType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("format_version", T.IntegerType()),
        T.StructField("time", T.TimestampType()),
    ]
)

BLOOM = T.StructType([T.StructField("part", T.IntegerType(), False), T.StructField("bucket", T.LongType(), False), T.StructField("bits", T.BinaryType(), False)])

FORMAT_VERSION = 3

#: Numbers of the log's record types.
RECORD_TYPES = {1: "PUT", 2: "DEL", 3: "CLEAR", 4: "CHECKPOINT_START", 5: "CHECKPOINT_END", 6: "BEGIN", 7: "PREPARE", 8: "COMMIT", 9: "ABORT"}
DATA_OPS = ("PUT", "DEL", "CLEAR")
TXN_OPS = ("BEGIN", "PREPARE", "COMMIT", "ABORT")

#: Limits on keys and values in bytes, on reads and on recovery.
READ_LIMITS = {"key_min": 1, "key_max": 1 << 20, "value_max": 10 << 20}
RECOVERY_LIMITS = {"key_min": 1, "key_max": 10_000_000, "value_max": 50_000_000}


@dataclass(frozen=True)
class KeyRange:
    """A range of keys; a missing bound is open. ``KeyRange.half_open(a, b)`` is a <= key < b."""

    low: object = None
    high: object = None
    low_inclusive: bool = True
    high_inclusive: bool = False

    def __post_init__(self) -> None:
        if self.low is not None and self.high is not None:
            if self.low > self.high:
                raise ValueError(f"range starts at {self.low!r}, after its end {self.high!r}")
            if self.low == self.high and not self.low_inclusive and not self.high_inclusive:
                raise ValueError(f"range excludes both its equal bounds {self.low!r}")

    @classmethod
    def half_open(cls, low: object, high: object) -> KeyRange:
        return cls(low, high)

    @classmethod
    def closed(cls, low: object, high: object) -> KeyRange:
        return cls(low, high, high_inclusive=True)

    @classmethod
    def starting_at(cls, low: object) -> KeyRange:
        return cls(low=low)

    @classmethod
    def up_to(cls, high: object) -> KeyRange:
        return cls(high=high)

    @classmethod
    def exclusive(cls, low: object, high: object) -> KeyRange:
        return cls(low, high, low_inclusive=False)

    @classmethod
    def full(cls) -> KeyRange:
        return cls()

    def predicate(self, key: Column) -> Column:
        """Plain comparisons, which reach the Parquet scan."""
        out = F.lit(True)
        if self.low is not None:
            out = key >= F.lit(self.low) if self.low_inclusive else key > F.lit(self.low)
        if self.high is not None:
            upper = key <= F.lit(self.high) if self.high_inclusive else key < F.lit(self.high)
            out = upper if self.low is None else out & upper
        return out
