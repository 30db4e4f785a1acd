import pytest

from siltstone import errors
from siltstone.schema import KeyRange
from siltstone.sources import log as log_source
from siltstone.sources import segment
from siltstone.table import KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t")


def rows(spark, **pairs):
    return spark.createDataFrame([(k, v.encode()) for k, v in pairs.items()], "key string, value binary")


def read(df):
    return {r["key"]: bytes(r["value"]) for r in df.collect()}


def test_insert_overwrite_remove(table):
    assert table.is_empty()
    assert table.insert("k", b"1234") is None
    assert table.insert("k", b"5678") == b"1234"
    assert table.get("k") == b"5678"
    assert table.contains_key("k") and not table.contains_key("x")
    assert table.size_bytes() == 1 + 4 + 32
    assert table.remove("k") == b"5678"
    assert table.remove("k") is None
    assert table.get("k") is None and table.len() == 0
    with pytest.raises(errors.IndexKeyNotFound):
        table.delete_existing("k")


def test_edge_values(table):
    table.insert("", b"empty key")
    table.insert("empty value", b"")
    assert table.get("") == b"empty key" and table.get("empty value") == b""
    assert table.len() == 2


def test_ranges(spark, table):
    table.put(rows(spark, **{f"key{i:02}": str(i) for i in range(10)}))
    count = lambda r: table.range(r).count()
    assert count(KeyRange.closed("key03", "key06")) == 4
    assert count(KeyRange.half_open("key03", "key06")) == 3
    assert count(KeyRange.starting_at("key08")) == 2
    assert count(KeyRange.up_to("key02")) == 2
    assert count(KeyRange.full()) == 10
    assert count(KeyRange.half_open("key99", "key999")) == 0
    assert count(KeyRange.exclusive("key04", "key07")) == 2
    assert [r["key"] for r in table.range(KeyRange.closed("key03", "key05")).collect()] == ["key03", "key04", "key05"]
    with pytest.raises(ValueError):
        KeyRange.half_open("b", "a")
    with pytest.raises(ValueError):
        KeyRange.exclusive("a", "a")


def test_batches_and_clear(spark, table):
    table.put(rows(spark, **{f"k{i}": "a" for i in range(10)}))
    table.delete(spark.createDataFrame([(f"k{i}",) for i in range(5)], "key string"))
    assert sorted(read(table.iter())) == [f"k{i}" for i in range(5, 10)]
    asked = spark.createDataFrame([("k1",), ("k7",)], "key string")
    assert {r["key"]: r["value"] for r in table.multi_get(asked).collect()} == {"k1": None, "k7": bytearray(b"a")}
    before = table.log.next_lsn() - 1
    table.clear()
    assert table.is_empty()
    table.insert("new", b"n")
    assert read(table.iter()) == {"new": b"n"}
    assert table.as_of(before).count() == 5


def test_capacity(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", capacity=80)
    table.insert("key1", b"12")
    with pytest.raises(errors.CapacityExceeded):
        table.insert("key2", bytes(60))
    assert table.get("key1") == b"12" and table.get("key2") is None
    table.insert("key1", bytes(40))
    assert not table.is_full()
    table.flush()
    assert table.unflushed_bytes() == 0
    table.insert("key2", bytes(40))
    assert table.len() == 2


def test_flush_recover_and_tombstones(spark, table):
    table.put(rows(spark, a="1", b="2", c="3"))
    first = table.flush()
    assert segment.read(spark, first).count() == 3
    table.remove("b")
    table.insert("c", b"33")
    table.flush()
    table.insert("d", b"4")
    fresh = table.recover()
    assert read(fresh.iter()) == {"a": b"1", "c": b"33", "d": b"4"}
    fresh.compact()
    assert read(fresh.iter()) == {"a": b"1", "c": b"33", "d": b"4"}
    live = fresh.manifest.segments()
    assert len(live) == 1 and live[0]["entry_count"] == 3  # no tombstone is left, and recovery has flushed the log


def test_clear_after_flush_and_empty_flush(spark, table):
    assert segment.read(spark, table.flush()).count() == 0
    table.put(rows(spark, a="1"))
    table.flush()
    table.clear()
    table.insert("b", b"2")
    assert read(table.iter()) == {"b": b"2"}
    table.flush()
    assert read(table.recover().iter()) == {"b": b"2"}


def test_partial_compaction_keeps_tombstones(spark, table):
    table.put(rows(spark, a="1", b="1"))
    table.flush()
    table.remove("a")
    second = table.flush()
    table.insert("b", b"2")
    third = table.flush()
    table.compact([second, third])
    assert read(table.iter()) == {"b": b"2"}
    with pytest.raises(errors.InvalidOperation):
        table.compact(["nowhere"])


def test_transactions(spark, table):
    one, two, three = (table.begin_transaction() for _ in range(3))
    assert [one, two, three] == [1, 2, 3]
    for t in (one, two, three):
        table.add_to_transaction(t, [("PUT", f"k{t}", b"v")])
    table.commit_transaction(one)
    table.prepare_transaction(two)
    with pytest.raises(errors.TransactionAlreadyPrepared):
        table.prepare_transaction(two)
    with pytest.raises(errors.TransactionWrongState):
        table.add_to_transaction(two, [("PUT", "x", b"v")])
    with pytest.raises(errors.InvalidOperation):
        table.flush()
    table.commit_transaction(two)
    table.abort_transaction(three)
    with pytest.raises(errors.TransactionAlreadyAborted):
        table.commit_transaction(three)
    with pytest.raises(errors.TransactionAlreadyCommitted):
        table.add_to_transaction(one, [("PUT", "x", b"v")])
    with pytest.raises(errors.TransactionNotFound):
        table.commit_transaction(999999)
    assert read(table.iter()) == {"k1": b"v", "k2": b"v"}
    assert table.execute_batch([]) is None
    table.execute_batch([("PUT", "b0", b"0"), ("PUT", "b1", b"1"), ("DEL", "b0", None), ("CLEAR", None, None), ("PUT", "c", b"c")])
    assert read(table.iter()) == {"c": b"c"}
    assert table.recover().begin_transaction() == 7  # after those of its checkpoint's two records


def test_checkpoints_and_corruption(spark, table):
    table.insert("a", b"1")
    number, lsn = table.begin_checkpoint()
    table.end_checkpoint(number)
    table.insert("b", b"2")
    assert log_source.checkpoint_lsn(table.log.read(), number) == lsn
    with pytest.raises(errors.CheckpointNotFound):
        log_source.checkpoint_lsn(table.log.read(), 12345)
    with pytest.raises(errors.IntegrityCheckFailed):
        table.register_durable_checkpoint(number)
    path = table.flush()
    with pytest.raises(errors.IntegrityCheckFailed):
        segment.verify(spark, path, 3)
    with pytest.raises(errors.IntegrityCheckFailed):
        segment.verify(spark, path + "-missing", 2)
    with pytest.raises(errors.DataCorruption):
        segment.read(spark, path, format_version=99)
    rotten = path + "-rotten"
    from pyspark.sql import functions as F

    segment.read(spark, path).withColumn("value", F.lit(b"other")).write.parquet(rotten)
    with pytest.raises(errors.DataCorruption):
        segment.verify(spark, rotten, 2)


def test_latest_complete_segment(spark, table, tmp_path):
    import shutil

    assert table.latest_complete_segment() is None
    table.insert("a", b"1")
    first = table.flush()
    table.insert("b", b"2")
    second = table.flush()
    assert table.latest_complete_segment() == second
    shutil.rmtree(second.removeprefix("file://"))
    assert table.latest_complete_segment() == first
    with pytest.raises(errors.IntegrityCheckFailed):
        table.recover()


def test_log_checksums(table):
    table.insert("a", b"1")
    table.remove("a")
    valid = log_source.split_valid(table.log.ordered())
    assert [r["valid"] for r in valid.collect()] == [True] * 6  # each write is a transaction
    from pyspark.sql import functions as F

    assert log_source.split_valid(table.log.read().withColumn("key", F.lit("z"))).filter("valid").count() == 0


def test_messages():
    assert str(errors.CapacityExceeded()) == "Memtable capacity exceeded"
    assert str(errors.KeyNotFound()) == "Key not found in memtable"
    assert str(errors.InvalidRecord()) == "Invalid WAL record format"
    assert str(errors.CheckpointNotFound()) == "Checkpoint not found"
    assert isinstance(errors.TransactionNotFound(3), errors.DurabilityError)


def test_a_crash_while_the_log_is_cut_loses_nothing(spark, table, monkeypatch):
    table.put(rows(spark, a="1", b="2"))
    table.flush()
    table.insert("c", b"3")
    last = table.log.next_lsn()

    def crash(*_, **__):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(table.manifest, "add", crash)
        with pytest.raises(RuntimeError):
            table.log.truncate(last)
    fresh = KeyedTable(spark, table.base_path)
    assert read(fresh.iter()) == {"a": b"1", "b": b"2", "c": b"3"} and fresh.log.next_lsn() >= last
    fresh = fresh.recover()
    assert read(fresh.iter()) == {"a": b"1", "b": b"2", "c": b"3"}
    assert fresh.unflushed_bytes() == 0 and fresh.log.next_lsn() > last


def test_as_of_before_a_flush_is_an_error(spark, table):
    first = table.put(rows(spark, a="1"))
    second = table.put(rows(spark, a="2"))
    assert read(table.as_of(first)) == {"a": b"1"}
    table.flush()
    with pytest.raises(errors.InvalidOperation):
        table.as_of(first)
    third = table.put(rows(spark, a="3"))
    table.put(rows(spark, a="4"))
    assert read(table.as_of(third)) == {"a": b"3"} and second < third


def test_damaged_records_are_refused(spark, table):
    from pyspark.sql import functions as F

    table.put(rows(spark, a="1", b="2"))
    bad = table.log.raw().withColumn("value", F.lit(b"other")).collect()
    spark.createDataFrame(bad, table.log.raw().schema).write.mode("overwrite").parquet(table.log.path)
    with pytest.raises(Exception, match="Invalid WAL record format"):
        table.iter().collect()
    with pytest.raises(errors.InvalidRecord):
        table.recover()


def test_damaged_entries_are_refused(spark, table):
    from pyspark.sql import functions as F

    table.put(rows(spark, a="1", b="2"))
    path = table.flush()
    bad = segment.read(spark, path).withColumn("value", F.lit(b"other")).collect()
    spark.createDataFrame(bad, segment.read(spark, path).schema).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="checksum differs"):
        table.get("a")


def test_open_transactions_survive_a_restart_and_a_flush(spark, table):
    one, two = table.begin_transaction(), table.begin_transaction()
    table.add_to_transaction(one, [("PUT", "x", b"1")])
    table.add_to_transaction(two, [("PUT", "y", b"2")])
    table.prepare_transaction(two)
    table.insert("z", b"3")
    fresh = table.recover()
    assert read(fresh.iter()) == {"z": b"3"} and fresh.unflushed_bytes() == 0
    fresh.commit_transaction(two)
    fresh.abort_transaction(one)
    assert read(fresh.iter()) == {"y": b"2", "z": b"3"}
    assert fresh.flush() and read(fresh.iter()) == {"y": b"2", "z": b"3"}


def test_one_writer(spark, table):
    table.insert("a", b"1")
    other = KeyedTable(spark, table.base_path)
    other.insert("b", b"2")
    with pytest.raises(errors.LogError):
        table.insert("c", b"3")
    assert read(table.iter()) == {"a": b"1", "b": b"2"}


@pytest.mark.parametrize("parts", [1, 4])
def test_filters_skip_segments(spark, tmp_path, parts):
    table = KeyedTable(spark, f"file://{tmp_path}/t", bloom_partitions=parts)
    for n in range(3):
        table.put(rows(spark, **{f"k{n}-{i}": "v" for i in range(40)}))
        path = table.flush()
    assert table.get("k1-7") == b"v" and table.segments_read < 3
    assert table.get("none") is None and table.segments_read < 3
    reader = segment.SegmentReader(spark, path)
    assert reader.has_bloom_filter and reader.entry_count() == 40
    assert all(reader.may_contain(f"k2-{i}") for i in (0, 39)) and reader.get("k2-3") == b"v" and reader.get("k0-3") is None
    asked = spark.createDataFrame([(f"k{n}-{i}",) for n in (0, 2) for i in range(40)], "key string")
    said = {r["key"]: r["may_contain"] for r in reader.may_contain_batch(asked).collect()}
    assert all(said[f"k2-{i}"] for i in range(40)) and sum(said.values()) < 50
    empty = KeyedTable(spark, f"file://{tmp_path}/e")
    assert segment.SegmentReader(spark, empty.flush()).get("a") is None and empty.get("a") is None


def test_reads_by_reference(spark, table):
    table.put(rows(spark, a="1", b="2", c="3"))
    table.flush()
    table.remove("b")
    table.flush()
    table.insert("c", b"33")
    index = table.index()
    found = {r["key"]: (r["value"], r["storage_ref"]) for r in index.entries.collect()}
    assert found["a"][1]["is_tombstone"] is False and found["b"][1]["is_tombstone"] and found["c"][1] is None
    assert read(table.load(index)) == {"a": b"1", "c": b"33"} == read(table.iter())
