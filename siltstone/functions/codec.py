"""Sizes, checksums and codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.schema import RECORD_TYPES, TXN_OPS

#: Bytes that an entry is charged beside its key and its value.
KEY_OVERHEAD, VALUE_OVERHEAD, ENTRY_OVERHEAD = 8, 16, 8


def key_size(key: Column) -> Column:
    return (F.octet_length(key) + KEY_OVERHEAD).cast("long")


def value_size(value: Column) -> Column:
    return (F.octet_length(value) + VALUE_OVERHEAD).cast("long")


def entry_size(key: Column, value: Column) -> Column:
    """What a live entry counts towards a table's size."""
    return key_size(key) + value_size(value) + ENTRY_OVERHEAD


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def is_text(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def from_bytes(data: Column) -> Column:
    """Text of UTF-8 bytes; null where they are not valid."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def checksum(data: Column) -> Column:
    """CRC-32 as an unsigned number."""
    return F.crc32(data)


def entry_frame(key: Column, value: Column) -> Column:
    """Lengths, key and value as one byte string: no two entries share one."""
    head = F.concat_ws("|", F.octet_length(key).cast("string"), F.octet_length(value).cast("string"), F.lit(""))
    return F.concat(F.encode(head, "UTF-8"), F.coalesce(F.encode(key, "UTF-8"), F.lit(b"")), F.coalesce(value, F.lit(b"")))


def entry_checksum(key: Column, value: Column) -> Column:
    return checksum(entry_frame(key, value))


def record_checksum(op: Column, key: Column, value: Column, id_: Column, txn_id: Column) -> Column:
    head = F.concat_ws("|", op, id_.cast("string"), txn_id.cast("string"), F.lit(""))
    return checksum(F.concat(F.encode(head, "UTF-8"), entry_frame(key, value)))


def record_type(number: Column) -> Column:
    """Name of a record type's number, UNKNOWN for others."""
    out = F.lit("UNKNOWN")
    for n, name in RECORD_TYPES.items():
        out = F.when(number == n, name).otherwise(out)
    return out


def is_transaction_control(op: Column) -> Column:
    return op.isin(*TXN_OPS)


def segment_checkpoint_id(path: Column) -> Column:
    """The checkpoint's number in a segment's name, ``sstable_<id>[_<time>].sst``; null for other names."""
    return F.regexp_extract(path, r"(?:^|/)sstable_(\d+)(?:_[^/]*)?\.sst$", 1).try_cast("long")
