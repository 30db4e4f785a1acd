from siltstone.streaming import ingest
from siltstone.table import KeyedTable

SCHEMA = "order long, op string, key string, value binary"


def test_stream_into_table(spark, tmp_path):
    source, table = f"{tmp_path}/in", KeyedTable(spark, f"file://{tmp_path}/t", capacity=60)

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def drain():
        ingest.ingest(spark.readStream.schema(SCHEMA).parquet(source), table, f"{tmp_path}/cp").awaitTermination()

    feed([(1, "PUT", "a", b"1"), (2, "PUT", "b", b"1"), (3, "PUT", "a", b"2")])
    drain()
    assert {r["key"]: bytes(r["value"]) for r in table.iter().collect()} == {"a": b"2", "b": b"1"}
    assert len(table.manifest.segments()) == 1  # it was full, so it was flushed
    feed([(4, "DEL", "a", None), (5, "PUT", "c", b"3")])
    drain()
    assert {r["key"]: bytes(r["value"]) for r in table.recover().iter().collect()} == {"b": b"1", "c": b"3"}


def test_a_timed_stream_flushes_what_is_not_full(spark, tmp_path):
    source, table = f"{tmp_path}/in", KeyedTable(spark, f"file://{tmp_path}/t")
    spark.createDataFrame([(1, "PUT", "a", b"1"), (2, "PUT", "b", b"2")], SCHEMA).coalesce(1).write.parquet(source)
    query = ingest.ingest(spark.readStream.schema(SCHEMA).parquet(source), table, f"{tmp_path}/cp", every="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert len(table.manifest.segments()) == 1 and table.unflushed_bytes() == 0
    assert not ingest.append_batch(table, spark.createDataFrame([(1, "PUT", "a", b"1")], SCHEMA), 0)
    assert {r["key"]: bytes(r["value"]) for r in table.recover().iter().collect()} == {"a": b"1", "b": b"2"}


def test_a_batch_counts_once(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "PUT", "a", b"1")], SCHEMA)
    table.log.append([("PUT", "z", b"0", None, 0)])
    assert ingest.append_batch(table, rows, 0) and not ingest.append_batch(table, rows, 0)
    assert table.len() == 2


def test_a_batch_counts_once_after_a_flush(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t")
    old = spark.createDataFrame([(1, "PUT", "a", b"old")], SCHEMA)
    assert ingest.append_batch(table, old, 0)
    table.flush()
    table.insert("a", b"new")
    table.flush()
    assert not ingest.append_batch(table, old, 0) and table.get("a") == b"new"
    assert ingest.append_batch(table, spark.createDataFrame([(1, "PUT", "b", b"2")], SCHEMA), 1) and table.len() == 2
    assert ingest.append_batch(table, old, 0, stream_id=2)
