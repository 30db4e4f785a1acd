"""The keyed table: a mutation log, segments and a manifest below one path.

The in-memory table of such stores has no counterpart here: what isn't flushed
is the log's tail. A read is a fold over live segments and the tail; point and
range predicates on the key are put below the fold, so they reach the scans.
Set-based methods (``put``, ``delete``, ``multi_get``) are the ones for volume,
single-key methods are conveniences over them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.functions.bloom_math import BloomParams
from siltstone.functions.codec import entry_size
from siltstone.operators import bloom, compaction, fold, lookup, txn
from siltstone.operators.index import STORAGE_REF, OrderedIndex
from siltstone.schema import KeyRange
from siltstone.sources import log as log_source
from siltstone.sources import segment
from siltstone.sources.manifest import Manifest, checkpoints

Operation = tuple[str, str | None, bytes | None]


class KeyedTable:
    def __init__(self, spark: SparkSession, base_path: str, capacity: int | None = None, compaction_ratio: float = 1.5, use_bloom: bool = True, false_positive_rate: float = 0.01, bloom_partitions: int = 1):
        self.spark, self.base_path = spark, base_path.rstrip("/")
        self.capacity, self.compaction_ratio = capacity, compaction_ratio
        self.use_bloom, self.rate = use_bloom, false_positive_rate
        self.bloom_partitions = bloom_partitions
        self.manifest = Manifest(spark, f"{self.base_path}/manifest")
        self.log = log_source.Log(spark, f"{self.base_path}/log", self.manifest)
        self._transactions: dict[int, str] = {}
        self._next_txn = 1

    # -- reading

    def _snapshot(self, key: str | None = None) -> DataFrame | None:
        """Last writes of all live segments, tombstones included; for one key, of those whose filters don't rule it out."""
        live = self.manifest.segments()
        if key is not None:
            filtered = [r["segment_path"] for r in live if r["has_bloom_filter"]]
            hit = set(segment.may_contain(self.spark, filtered, key)) if filtered else set()
            live = [r for r in live if not r["has_bloom_filter"] or r["segment_path"] in hit]
        self.segments_read = len(live)
        if not live:
            return None
        parts = [segment.checked(segment.read(self.spark, r["segment_path"], r["format_version"])).select("key", "value", "lsn", "tombstone") for r in live]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def state(self, where: Column | None = None, upto_lsn: int | None = None, key: str | None = None) -> DataFrame:
        """key, value, lsn of live entries. ``where`` is about the key and goes below the fold; ``key`` is the only one asked for."""
        if key is not None:
            where = F.col("key") == key
        tail = fold.committed(fold.upto(self.log.read(), upto_lsn))
        rows = tail.filter(F.col("op").isin("PUT", "DEL")).select("key", "value", "lsn", (F.col("op") == "DEL").alias("tombstone"))
        snapshot = self._snapshot(key)
        if snapshot is not None:
            rows = rows.unionByName(fold.upto(snapshot, upto_lsn))
        rows = rows.filter(F.col("lsn") > fold.last_clear(tail))
        if where is not None:
            rows = rows.filter(where)
        last = rows.groupBy("key").agg(F.max_by(F.struct("value", "tombstone"), "lsn").alias("x"), F.max("lsn").alias("lsn"))
        return last.filter(~F.col("x.tombstone")).select("key", "x.value", "lsn")

    def get(self, key: str) -> bytes | None:
        row = self.state(key=key).first()
        return None if row is None else bytes(row["value"])

    def contains_key(self, key: str) -> bool:
        return not self.state(key=key).isEmpty()

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return lookup.multi_get(self.state().select("key", "value"), keys)

    def range(self, keys: KeyRange = KeyRange()) -> DataFrame:
        return self.state(keys.predicate(F.col("key"))).select("key", "value").orderBy("key")

    def iter(self) -> DataFrame:
        return self.range()

    def len(self) -> int:
        return self.state().count()

    def is_empty(self) -> bool:
        return self.state().isEmpty()

    def size_bytes(self) -> int:
        return self.state().agg(F.coalesce(F.sum(entry_size(F.col("key"), F.col("value"))), F.lit(0))).first()[0]

    def max_capacity(self) -> int | None:
        return self.capacity

    def is_full(self) -> bool:
        return self.capacity is not None and self.size_bytes() >= self.capacity

    def as_of(self, lsn: int) -> DataFrame:
        """State at an LSN; an error before the last flush, as segments have the last writes only."""
        if lsn < (least := self.manifest.whole_from()):
            raise errors.InvalidOperation(f"the state at LSN {lsn} is gone; the oldest is that at {least}")
        return self.state(upto_lsn=lsn)

    def index(self) -> OrderedIndex:
        """The ordered index: unflushed entries with their value, flushed ones with the place in their segment."""
        tail = fold.committed(self.log.read())
        none = F.lit(None)
        rows = tail.filter(F.col("op").isin("PUT", "DEL")).select("key", "value", none.cast(STORAGE_REF).alias("storage_ref"), "lsn")
        for r in self.manifest.segments():
            found = segment.index(self.spark, r["segment_path"]).join(segment.read(self.spark, r["segment_path"]).select("key", "lsn"), "key")
            rows = rows.unionByName(found.select("key", none.cast("binary").alias("value"), "storage_ref", "lsn"))
        return OrderedIndex(fold.index_entries(rows.filter(F.col("lsn") > fold.last_clear(tail))))

    def load(self, index: OrderedIndex) -> DataFrame:
        """key and value of an index's live entries, those with a reference read where it points."""
        live = index.live()
        return live.filter("storage_ref IS NULL").select("key", "value").unionByName(segment.load(self.spark, live.filter("storage_ref IS NOT NULL")))

    # -- writing

    def _admit(self, key: str, value: bytes) -> bytes | None:
        """Old value; raises before anything is logged if the new one doesn't fit."""
        old = self.get(key)
        if self.capacity is not None:
            one = len(key.encode()) + 32
            after = self.unflushed_bytes() - (one + len(old) if old is not None and self._unflushed(key) else 0) + one + len(value)
            if after > self.capacity:
                raise errors.CapacityExceeded
        return old

    def _tail_state(self) -> DataFrame:
        return fold.replay(self.log.read())

    def _unflushed(self, key: str) -> bool:
        return not self._tail_state().filter(F.col("key") == key).isEmpty()

    def unflushed_bytes(self) -> int:
        """Size of what is in the log only; a flush brings it to 0."""
        return self._tail_state().agg(F.coalesce(F.sum(entry_size(F.col("key"), F.col("value"))), F.lit(0))).first()[0]

    def insert(self, key: str, value: bytes) -> bytes | None:
        old = self._admit(key, value)
        self.execute_transaction(("PUT", key, value))
        return old

    def remove(self, key: str) -> bytes | None:
        """Old value; a missing key is no error."""
        old = self.get(key)
        self.execute_transaction(("DEL", key, None))
        return old

    def delete_existing(self, key: str) -> bytes:
        """As remove, but a missing key is an error."""
        if not self.contains_key(key):
            raise errors.IndexKeyNotFound
        return self.remove(key)

    def put(self, rows: DataFrame) -> int:
        """Upserts rows (key, value) of distinct keys in one commit; returns its LSN."""
        return self.log.append_frame(rows, "PUT")[1]

    def delete(self, keys: DataFrame) -> int:
        return self.log.append_frame(keys, "DEL")[1]

    def clear(self) -> None:
        self.execute_transaction(("CLEAR", None, None))

    # -- segments, checkpoints, recovery

    def _mark(self, op: str, number: int) -> int:
        """Logs a checkpoint's record in a transaction of its own; returns its LSN."""
        own, self._next_txn = self._next_txn, self._next_txn + 1
        return self.log.append([("BEGIN", None, None, None, own), (op, None, None, number, own), ("COMMIT", None, None, None, own)])[0] + 1

    def begin_checkpoint(self) -> tuple[int, int]:
        """(id, LSN of its start)."""
        number = self.manifest.next_seq()
        lsn = self._mark("CHECKPOINT_START", number)
        self.manifest.add("CREATED", checkpoint_id=number, lsn=lsn)
        return number, lsn

    def end_checkpoint(self, number: int) -> None:
        self._mark("CHECKPOINT_END", number)

    def flush(self) -> str:
        """Log up to now to a verified segment; then the log keeps its tail. An empty flush is an empty segment.

        A CLEAR in the log makes the segment replace all older ones. An open
        transaction of this object is an error; one of another process keeps its
        records in the log.
        """
        if open_ := [t for t, s in self._transactions.items() if s in (txn.STARTED, txn.PREPARED)]:
            raise errors.InvalidOperation(f"transactions {open_} are not finished")
        return self._flush()

    def _flush(self) -> str:
        number, lsn = self.begin_checkpoint()
        tail = fold.committed(fold.upto(self.log.read(), lsn))
        cleared = not tail.filter("op = 'CLEAR'").isEmpty()
        rows = fold.last_writes(fold.after_last_clear(tail)).select("key", F.coalesce("value", F.lit(b"")).alias("value"), "lsn", (F.col("op") == "DEL").alias("tombstone"))
        path = self._segment_path(number)
        live = [r["segment_path"] for r in self.manifest.segments()]
        segment.write(rows, path, self.use_bloom)
        self.end_checkpoint(number)
        self._register(path, number, lsn, live if cleared else [])
        self.log.truncate(lsn)
        return path

    def _segment_path(self, number: int) -> str:
        return f"{self.base_path}/segments/sstable_{number:012d}.sst"

    def _register(self, path: str, number: int, lsn: int, replaces: list[str]) -> None:
        about = segment.stats(segment.read(self.spark, path)).first()
        segment.verify(self.spark, path, about["entry_count"])
        if self.use_bloom:
            segment.write_bloom(self.spark, path, BloomParams.partitioned(about["entry_count"], self.rate, self.bloom_partitions))
        self.manifest.add("SEGMENT", checkpoint_id=number, segment_path=path, replaces=replaces, size_bytes=about["size_bytes"], entry_count=about["entry_count"], has_bloom_filter=self.use_bloom, lsn=lsn)
        self.manifest.add("DURABLE", checkpoint_id=number, segment_path=path, lsn=lsn)

    def register_durable_checkpoint(self, number: int) -> None:
        """For a checkpoint whose segment exists: verified again, and the log cut at its start."""
        row = checkpoints(self.manifest.read()).filter(F.col("checkpoint_id") == number).first()
        if row is None:
            raise errors.CheckpointNotFound
        if row["segment_path"] is None:
            raise errors.IntegrityCheckFailed(number)
        self.log.truncate(log_source.checkpoint_lsn(self.log.read(), number))

    def latest_complete_segment(self) -> str | None:
        """The newest live segment that verifies; damaged ones are passed over."""
        for r in reversed(self.manifest.segments()):
            try:
                segment.verify(self.spark, r["segment_path"], r["entry_count"])
            except errors.DurabilityError:
                continue
            return r["segment_path"]
        return None

    def recover(self, checkpoint: bool = True) -> KeyedTable:
        """A table as a new process finds it: live segments that verify, then the log's committed tail, whose records must be sound.

        What the log holds then goes to a new checkpoint, and the log is cut;
        transactions that are open there are known again and keep their records.
        """
        for r in self.manifest.segments():
            segment.verify(self.spark, r["segment_path"], r["entry_count"])
        fresh = KeyedTable(self.spark, self.base_path, self.capacity, self.compaction_ratio, self.use_bloom, self.rate, self.bloom_partitions)
        fresh.log.verify()
        log = fresh.log.read()
        fresh._next_txn = (log.agg(F.max("txn_id")).first()[0] or 0) + 1
        open_ = fold.transaction_status(log).filter(F.col("status").isin(txn.STARTED, txn.PREPARED))
        fresh._transactions = {r["txn_id"]: r["status"] for r in open_.collect()}
        if checkpoint and not fold.committed(log).filter(F.col("op").isin("PUT", "DEL", "CLEAR")).isEmpty():
            fresh._flush()
        return fresh

    def compaction_groups(self, min_group: int = 2) -> list[list[str]]:
        live = self.manifest.segments()
        infos = self.spark.createDataFrame([(i, r["size_bytes"]) for i, r in enumerate(live)], "idx long, size_bytes long")
        groups: dict[int, list[str]] = {}
        for r in compaction.tier_groups(infos, self.compaction_ratio, min_group).orderBy("group", "size_bytes", "idx").collect():
            groups.setdefault(r["group"], []).append(live[r["idx"]]["segment_path"])
        return list(groups.values())

    def compact(self, paths: Iterable[str] | None = None) -> str:
        """Merges segments, by default all; tombstones go if nothing older than the oldest remains."""
        live = self.manifest.segments()
        chosen = [r for r in live if paths is None or r["segment_path"] in set(paths)]
        if not chosen or (paths is not None and len(chosen) != len(set(paths))):
            raise errors.InvalidOperation("no such segments")
        number, _ = self.begin_checkpoint()
        whole = [r["segment_path"] for r in live[: len(chosen)]] == [r["segment_path"] for r in chosen]
        # LSNs order the writes of a key, so segments in between may stay where they are
        merged = compaction.merge([segment.checked(segment.read(self.spark, r["segment_path"])).drop("crc") for r in chosen], whole, by="lsn")
        path = self._segment_path(number)
        segment.write(merged, path, self.use_bloom)
        self.end_checkpoint(number)
        # of the log nothing is gone: history reaches back as far as before
        self._register(path, number, max(r["lsn"] for r in chosen), [r["segment_path"] for r in chosen])
        return path

    def bloom_filter(self) -> tuple[DataFrame, BloomParams]:
        keys = self.state().select("key")
        params = BloomParams.of(keys.count(), self.rate)
        return bloom.build(keys, params), params

    def shutdown(self) -> None:
        """Nothing to release: all state is in files."""

    # -- transactions

    def begin_transaction(self) -> int:
        number, self._next_txn = self._next_txn, self._next_txn + 1
        self.log.append([("BEGIN", None, None, None, number)])
        self._transactions[number] = txn.STARTED
        return number

    def _step(self, number: int, action: str) -> None:
        self._transactions[number] = txn.step(number, self._transactions.get(number), action)

    def add_to_transaction(self, number: int, operations: Iterable[Operation]) -> None:
        self._step(number, "ADD")
        self.log.append([(op, key, value, None, number) for op, key, value in operations])

    def prepare_transaction(self, number: int) -> None:
        self._step(number, "PREPARE")
        self.log.append([("PREPARE", None, None, None, number)])

    def commit_transaction(self, number: int) -> None:
        self._step(number, "COMMIT")
        self.log.append([("COMMIT", None, None, None, number)])

    def abort_transaction(self, number: int) -> None:
        self._step(number, "ABORT")
        self.log.append([("ABORT", None, None, None, number)])

    def execute_batch(self, operations: Iterable[Operation]) -> int | None:
        """All operations in one transaction and one append; nothing to do for none."""
        some = list(operations)
        if not some:
            return None
        number, self._next_txn = self._next_txn, self._next_txn + 1
        control = [[(op, None, None, None, number)] for op in ("BEGIN", "COMMIT")]
        self.log.append([*control[0], *((op, key, value, None, number) for op, key, value in some), *control[1]])
        self._transactions[number] = txn.COMMITTED
        return number

    def execute_transaction(self, operation: Operation) -> int | None:
        return self.execute_batch([operation])
