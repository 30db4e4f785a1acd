import pytest

from siltstone import errors
from siltstone.operators.index import OrderedIndex
from siltstone.schema import KeyRange


def batch(spark, rows):
    return spark.createDataFrame(rows, "key int, value string, storage_ref struct<file_path: string, offset: bigint, is_tombstone: boolean>")


def test_index(spark):
    with pytest.raises(ValueError):
        OrderedIndex.empty(spark, order=2)
    none = OrderedIndex.empty(spark, "int", "string")
    assert none.is_empty() and none.len() == 0
    index = none.insert(batch(spark, [(i, f"value{i}", ("f.sst", i * 100, False)) for i in range(10)]))
    assert index.len() == 10 and none.is_empty()
    assert index.find(3).first()["storage_ref"]["offset"] == 300
    count = lambda r: index.range(r).count()
    assert [count(r) for r in (KeyRange.closed(3, 7), KeyRange.half_open(3, 7), KeyRange.starting_at(5), KeyRange.up_to(5), KeyRange(2, 8, False, True))] == [5, 4, 5, 5, 6]
    again = index.insert(batch(spark, [(3, "new", None), (4, None, ("f.sst", 1, True)), (5, None, None)]))
    assert tuple(again.find(3).first()) == (3, "new", None)  # the old reference is gone
    assert again.live().count() == 8
    assert again.delete(3).find(3).isEmpty()
    with pytest.raises(errors.IndexKeyNotFound):
        again.delete(33)
    keys = spark.createDataFrame([(1,), (99,)], "key int")
    assert again.remove(keys).len() == 9
    assert {r["key"]: r["found"] for r in again.contains(keys).collect()} == {1: True, 99: False}
    assert {r["key"]: r["value"] for r in again.find_many(keys).collect()} == {1: "value1", 99: None}
    assert again.clear().is_empty()
