import os
from collections import Counter

import pytest
from oracle import DATA, compare

import corpus_pipeline
from siltstone.llm import queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline(spark, docs, tmp_path):
    from test_llm_operators import brute_components, brute_exact, brute_fingerprint, brute_quality, brute_targets, words

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in now.collect()}
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        assert {tuple(r) for r in now.collect()} <= before  # whole rows, whatever their columns are called
        place = f"{tmp_path}/{name}"
        now.write.parquet(place)
        now = spark.read.parquet(place)
        seen[name] = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=repr)
    every = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    good = [r for r in every if brute_quality(r[1])[-1]]
    assert seen["quality_rules"] == sorted(((i, t) for i, t, _ in good), key=repr)
    _, first = brute_exact(good)
    assert sorted((i for i, _ in seen["exact_dedup"]), key=repr) == sorted(first.values(), key=repr)
    rows = [(i, t, None) for i, t in seen["exact_dedup"]]
    components = brute_components(rows, [brute_fingerprint(t) for _, t, _ in rows])
    assert {i for i, _ in seen["simhash_near_dedup"]} == set(components)
    assert {i for i, _ in seen["source_mix"]} <= {i for i, _ in seen["simhash_near_dedup"]}
    source = {(r["doc_id"], r["text"]): r["source"] for r in docs.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for row in seen["simhash_near_dedup"]:
        sizes[source[row]] += len(words(row[1]))
        largest[source[row]] = max(largest[source[row]], len(words(row[1])))
    for row in seen["source_mix"]:
        taken[source[row]] += len(words(row[1]))
    assert all(abs(taken[s] - t) <= largest[s] for s, t in brute_targets(sizes).items())
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == {i for i, _ in seen["source_mix"]}
    from tokenizers import Tokenizer

    from siltstone.llm import tokens

    plain = Tokenizer.from_file(tokens.default_path())
    ids = Counter({i: n * (len(plain.encode(t, add_special_tokens=False).ids) + 1) for (i, t), n in Counter(seen["source_mix"]).items()})
    found = Counter()
    for r in last.collect():
        found[r["doc_id"]] += r["length"]
    assert found == ids


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
