"""Parameters, hashes and error rates of Bloom filters, for the driver and as columns."""

from __future__ import annotations

import math
from hashlib import md5
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds on a filter's parameters.
MOST_ITEMS, MOST_BITS, MOST_HASHES, MOST_PARTITIONS, DEFAULT_RATE = 10_000_000, 100_000_000, 20, 64, 0.01


class BloomParams(NamedTuple):
    items: int
    rate: float
    bits: int
    hashes: int
    partitions: int = 1

    @classmethod
    def of(cls, items: int, rate: float = DEFAULT_RATE) -> BloomParams:
        n = min(max(items, 1), MOST_ITEMS)
        p = rate if 0.0 < rate < 1.0 else DEFAULT_RATE
        bits = min(math.ceil(-n * math.log(p) / math.log(2) ** 2), MOST_BITS)
        return cls(n, p, bits, min(max(math.ceil(bits / n * math.log(2)), 1), MOST_HASHES))

    @classmethod
    def partitioned(cls, items: int, rate: float, partitions: int) -> BloomParams:
        """Each part is sized for an equal share of the items."""
        if not 1 <= partitions <= MOST_PARTITIONS:
            raise ValueError(f"{partitions} partitions; 1 to {MOST_PARTITIONS} are possible")
        one = cls.of(-(-items // partitions), rate)
        return one._replace(partitions=partitions)

    @classmethod
    def from_parts(cls, bits: int, hashes: int, data_bytes: int) -> BloomParams:
        """Of a stored filter: no size means that of its data."""
        return cls(0, DEFAULT_RATE, min(bits or 8 * data_bytes, MOST_BITS), min(max(hashes, 1), MOST_HASHES))

    def false_positive_rate(self, items: int) -> float:
        """Expected, after so many insertions; of a partitioned filter the mean over its parts."""
        each = items // self.partitions
        return (1 - math.exp(-self.hashes * each / self.bits)) ** self.hashes


def params_columns(items: Column, rate: Column) -> dict[str, Column]:
    """The same formulas over columns: bits and hashes."""
    n = F.least(F.greatest(items, F.lit(1)), F.lit(MOST_ITEMS)).cast("double")
    p = F.when((rate > 0) & (rate < 1), rate).otherwise(DEFAULT_RATE)
    bits = F.least(F.ceil(-n * F.log(p) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))), F.lit(MOST_BITS)).cast("long")
    return {"bits": bits, "hashes": F.least(F.greatest(F.ceil(bits / n * F.log(F.lit(2.0))), F.lit(1)), F.lit(MOST_HASHES)).cast("long")}


def rate_column(items: Column, bits: Column, hashes: Column) -> Column:
    return F.pow(1 - F.exp(-hashes * items / bits), hashes)


def hash48(item: Column, salt: str) -> Column:
    """48 bits of a salted MD5: sums of products with small numbers stay within 64 bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), item).cast("binary")), 1, 12), 16, 10).cast("long")


def hash48_of(item: str, salt: str) -> int:
    """The same number for the driver."""
    return int(md5((salt + item).encode()).hexdigest()[:12], 16)


def positions(item: Column, params: BloomParams) -> Column:
    """Array of the bit positions of an item, by double hashing with an odd step."""
    h1, h2 = hash48(item, "a"), hash48(item, "b").bitwiseOR(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(params.hashes - 1)), lambda i: (h1 + i.cast("long") * h2) % params.bits)


def part_of(item: Column, params: BloomParams) -> Column:
    return (hash48(item, "p") % params.partitions).cast("int") if params.partitions > 1 else F.lit(0)
