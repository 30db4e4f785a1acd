import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions.bloom_math import BloomParams
from siltstone.operators import bloom, capacity, compaction, pages, txn
from siltstone.schema import KeyRange


def keys(spark, items):
    return spark.createDataFrame([(x,) for x in items], "key string")


def test_bloom_parameters():
    assert BloomParams.of(1000, 0.01)[2:4] == (9586, 7)
    assert BloomParams.of(0, 0.01).items == 1
    assert BloomParams.of(1000, 1.5) == BloomParams.of(1000, 0.01)
    assert BloomParams.of(10**9, 1e-9).bits == 100_000_000
    assert BloomParams.from_parts(0, 50, 100)[2:4] == (800, 20)
    with pytest.raises(ValueError):
        BloomParams.partitioned(100, 0.01, 65)


def test_bloom_no_false_negatives_and_rate(spark):
    p = BloomParams.of(1000, 0.05)
    f = bloom.build(keys(spark, map(str, range(1000))), p)
    hits = {r["key"]: r["may_contain"] for r in bloom.probe(keys(spark, map(str, range(2000))), f, p).collect()}
    assert all(hits[str(i)] for i in range(1000))
    assert sum(hits[str(i)] for i in range(1000, 2000)) < 100
    assert abs(p.false_positive_rate(1000) - 0.05) < 0.02


def test_bloom_merge_clear_and_batches(spark):
    p = BloomParams.of(100, 0.01)
    a, b = bloom.build(keys(spark, ["apple", "banana"]), p), bloom.build(keys(spark, ["cherry", "date"]), p)
    both = bloom.merge(a, p, b, p)
    asked = keys(spark, ["apple", "banana", "cherry", "date"])
    assert bloom.probe(asked, both, p).filter("may_contain").count() == 4
    with pytest.raises(ValueError):
        bloom.merge(a, p, b, BloomParams.of(200, 0.01))
    assert bloom.probe(asked, bloom.clear(both), p).filter("may_contain").count() == 0
    row = bloom.any_all(bloom.probe(keys(spark, []), both, p)).first()
    assert (row["any_hit"], row["all_hit"]) == (False, True)
    batch = spark.createDataFrame([(0, "apple"), (1, "grape"), (2, "apple")], "place long, key string")
    assert [r["may_contain"] for r in bloom.probe_batch(batch, both, p).orderBy("place").collect()] == [True, False, True]
    assert bloom.probe_batch(batch, None, p).filter("may_contain").count() == 3


def test_partitioned_bloom(spark):
    p = BloomParams.partitioned(10_000, 0.01, 4)
    f = bloom.build(keys(spark, (f"item-{i}" for i in range(10_000))), p)
    asked = keys(spark, (f"item-{i}" for i in range(9_900, 10_100)))
    hits = {r["key"]: r["may_contain"] for r in bloom.probe(asked, f, p).collect()}
    assert all(hits[f"item-{i}"] for i in range(9_900, 10_000))
    assert sum(hits[f"item-{i}"] for i in range(10_000, 10_100)) < 5


def groups(spark, sizes, ratio, least):
    infos = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "idx long, size_bytes long")
    out = {}
    for r in compaction.tier_groups(infos, ratio, least).orderBy("group", "size_bytes", "idx").collect():
        out.setdefault(r["group"], []).append(r["idx"])
    return list(out.values())


def plain_groups(sizes, ratio, least):
    out, now = [], []
    for s, i in sorted((s, i) for i, s in enumerate(sizes)):
        if now and s <= ratio * now[0][0]:
            now.append((s, i))
        else:
            out.append(now)
            now = [(s, i)]
    return [[i for _, i in g] for g in [*out, now] if len(g) >= least]


def test_tier_groups(spark):
    assert groups(spark, [100, 110, 200, 1000, 1100], 1.1, 2) == [[0, 1], [3, 4]]
    assert groups(spark, [], 1.1, 2) == []
    assert groups(spark, [0, 0], 1.5, 2) == [[0, 1]]
    assert len(groups(spark, [100, 110, 300, 320, 800], 3.0, 2)) <= len(groups(spark, [100, 110, 300, 320, 800], 1.2, 2))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 500), max_size=12), st.sampled_from([1.1, 1.5, 3.0]))
def test_tier_groups_as_plain(spark, sizes, ratio):
    assert groups(spark, sizes, ratio, 2) == plain_groups(sizes, ratio, 2)


def segment_of(spark, pairs):
    return spark.createDataFrame([(k, v, v is None) for k, v in pairs], "key string, value string, tombstone boolean")


def test_merge_later_wins(spark):
    a = segment_of(spark, [(f"key_{i}", str(i)) for i in range(10)])
    b = segment_of(spark, [(f"key_{i}", str(i + 100)) for i in range(5, 15)] + [("key_0", None)])
    kept = {r["key"]: r["value"] for r in compaction.merge([a, b], drop_tombstones=True).collect()}
    assert len(kept) == 14 and kept["key_7"] == "107" and kept["key_3"] == "3"
    assert compaction.merge([a, b]).filter("tombstone").count() == 1


def page(spark, numbers):
    entry = F.transform(F.array(*[F.lit(n) for n in numbers]), lambda x: F.struct(x.alias("key"), x.cast("string").alias("value")))
    return spark.range(1).select(entry.alias("entries"))


def test_pages(spark):
    def cut(numbers, leaf=True):
        s = page(spark, numbers).select(pages.split(F.col("entries"), leaf).alias("s")).first()["s"]
        return [x["key"] for x in s["left"]], s["median"], [x["key"] for x in s["right"]]

    assert cut([10, 20, 30, 40]) == ([10, 20], 30, [30, 40])
    assert cut([10, 20, 30, 40, 50]) == ([10, 20], 30, [30, 40, 50])
    assert cut([10, 20]) == ([10], 20, [20])
    assert cut([10, 20, 30, 40], leaf=False) == ([10], 20, [30, 40])
    p = page(spark, [10, 30, 50])
    ks = F.transform(F.col("entries"), lambda x: x["key"])
    assert [p.select(pages.lower_bound(ks, k)).first()[0] for k in (5, 20, 40, 60)] == [0, 1, 2, 3]
    new = F.struct(F.lit(30).alias("key"), F.lit("new").alias("value"))
    assert [x["value"] for x in p.select(pages.insert(F.col("entries"), new).alias("e")).first()["e"]] == ["10", "new", "50"]
    assert [x["key"] for x in p.select(pages.in_range(F.col("entries"), KeyRange.closed(30, 60)).alias("e")).first()["e"]] == [30, 50]


def test_an_inner_page_hands_the_promoted_child_on(spark):
    rows = spark.createDataFrame([([(10, "a", 1), (20, "b", 2), (30, "c", 3), (40, "d", None)],), ([(10, "a", None), (20, "b", None)],)], "entries array<struct<key: int, value: string, child: int>>")
    got = [r["s"] for r in rows.select(pages.split(F.col("entries"), leaf=False, child="child").alias("s")).collect()]
    assert [tuple(x) for x in got[0]["left"]] == [(10, "a", 1)] and got[0]["median"] == 20
    assert [tuple(x) for x in got[0]["right"]] == [(20, None, 2), (30, "c", 3), (40, "d", None)]
    assert got[1]["left"] == [] and got[1]["median"] == 10 and [x["key"] for x in got[1]["right"]] == [20]


def test_a_put_splits_a_page_that_it_overfills(spark):
    def put(numbers, key, most):
        new = F.struct(F.lit(key).alias("key"), F.lit("new").alias("value"))
        s = page(spark, numbers).select(pages.put(F.col("entries"), new, most).alias("s")).first()["s"]
        return [x["key"] for x in s["left"]], s["median"], s["right"] and [x["key"] for x in s["right"]]

    assert put([10, 20], 30, 2) == ([10], 20, [20, 30])
    assert put([10, 20], 20, 2) == ([10, 20], None, None)
    assert put([], 5, 2) == ([5], None, None)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_pages_of_any_split_follow_key_order(spark, by):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "cold", (i * 37) % 101) for i in range(100)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, key int").repartition(9)
    got = sorted(((r["g"] if by else 0) or "", r["key"], r["page"], r["slot"]) for r in pages.assign(df, 8, "key", *by).collect()) if by else sorted((r["key"], r["page"], r["slot"]) for r in pages.assign(df, 8).collect())
    want = []
    for g in sorted({x[0] or "" for x in rows}) if by else [None]:
        keys = sorted(k for h, k in rows if k is not None and (g is None or (h or "") == g))
        want += [((g,) if by else ()) + (k, i // 8, i % 8) for i, k in enumerate(keys)]
    assert got == sorted(want)


@pytest.mark.parametrize("by", [(), ("t",)])
def test_admission_by_brute_force(spark, by):
    import random

    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]) if by else "a", lsn, r.choice("xyz") + str(r.randrange(4)), b"v" * r.randrange(200)) for lsn in range(400)]
    want = []
    for t in {x[0] for x in rows}:
        live = {}
        for _, lsn, key, value in sorted(x for x in rows if x[0] == t) if t is not None else [x for x in rows if x[0] is None]:
            after = live | {key: len(key) + len(value) + 32}
            fits = sum(after.values()) <= 600
            live = after if fits else live
            want.append((t or "", lsn, fits, sum(live.values())))
    df = spark.createDataFrame(rows, "t string, lsn bigint, key string, value binary").repartition(7)
    got = [((x["t"] if by else "a") or "", x["lsn"], x["accepted"], x["size_bytes"]) for x in capacity.admit(df, 600, *by).collect()]
    assert sorted(got) == sorted(want)
    assert not all(x[2] for x in got) and any(x[2] for x in got)
    assert capacity.admit(df.limit(0), 600, *by).collect() == []
    assert [x["accepted"] for x in capacity.admit(spark.createDataFrame([("a", 1, "k", None)], df.schema), 600, *by).collect()] == [False]


def test_steps():
    assert txn.step(1, txn.STARTED, "COMMIT") == txn.COMMITTED
    assert txn.step(1, txn.PREPARED, "ABORT") == txn.ABORTED
