"""Each operator against a brute-force version, over rows with all the odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import classifier, exact_dedup, lm, mixing, packing, quality, simhash, substring, tokens, training_order, url_filter
from siltstone.llm.common import Scratch

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- packing


def test_packing_round_trip(docs, no_docs, rows):
    found = packing.pack(docs, window=64).collect()
    whole, total = defaultdict(list), Counter()
    for r in found:
        assert r["length"] * 4 == len(r["ids"]) and 1 <= r["length"] <= 64
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        total[r["sequence_id"]] += r["length"]
    at = defaultdict(list)
    for r in found:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    plain = Tokenizer.from_file(tokens.default_path())
    wanted, got = Counter(), Counter()
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 64):
            wanted[i, a, np.array(ids[a : a + 64], "<u4").tobytes()] += 1
    for r in found:
        got[r["doc_id"], r["start"], bytes(r["ids"])] += 1
    assert got == wanted
    assert sum(total.values()) / 64 / len(total) > 0.9
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("partitions", [1, 16, 211])
def test_padding_does_not_depend_on_the_split(spark, partitions):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, max(1, int(rng.lognormal(4, 1)))))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = packing.pack(docs).agg(F.sum("length").alias("ids"), F.countDistinct("sequence_id").alias("windows")).first()
    assert found["ids"] / found["windows"] / packing.WINDOW > 0.97


def test_best_fit_is_tightest():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500).tolist()
    placed = packing.best_fit_decreasing(lengths, 64)
    room, expected = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        expected[i] = min(fits, default=64)
        if fits:
            room.remove(min(fits))
        room.append(expected[i] - lengths[i])
    assert sorted(64 - o for _, o in placed) == sorted(expected)
    assert packing.best_fit_decreasing([], 64) == []


# -- quality


def brute_quality(text):
    w, t = words(text), text or ""
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    symbols, dup = sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    chars, stops = sum(map(len, w)), sum(x in quality.STOP_WORDS for x in w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    bad = 100 * chars < 200 * n or 100 * chars > 2000 * n or 100 * symbols > 30 * n or 100 * t.count("!") > 50 * n or 100 * stops < 2 * n or 100 * dup > 60 * len(lines)
    return n, chars, symbols, dup, len(covered), failed, not failed and not bad


def test_quality_rules(docs, no_docs, rows):
    m = [F.col(f"measures.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    found = by_row(quality.judge(docs).select("doc_id", *m, "base_failed", "kept"))
    assert found == sorted(((i, *brute_quality(t)) for i, t, _ in rows), key=repr)
    assert quality.judge(no_docs).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert by_row(kept.select("doc_id", "text")) == sorted(((i, t) for i, t, _ in rows if brute_quality(t)[-1]), key=repr)


def test_repeats_are_exact_whatever_the_hash(docs, rows, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 60)  # leaves four bits of the hash
    monkeypatch.setattr(quality, "MOST_PLACE", (1 << 60) - 1)
    found = by_row(quality.measure(docs).select("doc_id", "measures.n_repeat_words"))
    assert found == sorted(((i, brute_quality(t)[4]) for i, t, _ in rows), key=repr)


def test_good_prose_is_kept(spark):
    text = " ".join(f"the thing{x} of a place{x} and word{x}" for x in range(30))
    junk = " ".join(f"word{x}$$$ the%%%" for x in range(60))
    kept = {r["t"]: r["kept"] for r in quality.judge(spark.createDataFrame([("p", text), ("j", junk)], "t string, text string")).collect()}
    assert kept == {"p": True, "j": False}


# -- exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, min(known, default=None), len(ids), sha) for i in ids]
    return sorted(out, key=repr), {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (16, 64), (16, 3)])
def test_exact_dedup(docs, rows, block, bits):
    expected, first = brute_exact(rows)
    found = exact_dedup.dedup(docs, block, bits)
    assert by_row(found.drop("kept")) == expected
    kept = found.filter("kept").collect()
    assert len(kept) == len(first) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_stage(docs, no_docs, rows):
    _, first = brute_exact(rows)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((SPACE.sub(" ", r["text"] or ""), r["doc_id"]) for r in kept.collect()) == sorted(first.items())
    assert exact_dedup.dedup(no_docs).count() == 0 and exact_dedup.keep_first(no_docs).count() == 0


# -- url filter


def test_url_filter(spark):
    urls = [None, "", "nothing", "://", "HTTP://WWW.Example.NET/en/x?q#f", "http://example.net/de/", "x://a.example.com/de/1#t", "x://example.com.evil/de/", "x://notexample.com/de/1", "x://b.org/fr/", "x://b.org/fr", "x://org/fr/a?b", "x://h.net", "x://h.net?/en/", "http://a/b://c/d", "http://ÀB.net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(4, urls[4], "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(None, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[4] == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert found[5] == ("example.net", "/de/", "net/", "block")
    assert found[6][2:] == ("example.com/de/", "block")
    assert found[7][2] is None and found[8][2] is None
    assert found[9][2:] == ("org/fr/", "allow") and found[10][2] is None and found[11][2] == "org/fr/"
    assert found[12] == ("h.net", "", None, "allow") and found[13][1] == ""
    assert found[14] == ("a", "/b://c/d", None, "allow")
    assert found[15][0] == "Àb.net"
    assert url_filter.judge(pages, labels).count() == len(urls) + 1
    assert url_filter.judge(pages.limit(0), labels.limit(0)).count() == 0
    assert url_filter.judge(pages, labels.limit(0)).filter("rule IS NULL AND verdict <> 'allow'").count() == 0


def test_a_bad_host_without_a_rule_is_blocked(spark):
    hosts = ["user@Bad.spam.com:8080"] * 80 + ["bad.spam.com"] * 40 + ["new.fine.org"] * 2 + ["10.0.0.7"] * 60 + ["good.site.co.uk"] * 300 + ["ok.fine.org."] * 300
    urls = [(i, f"http://{h}/x") for i, h in enumerate(hosts)]
    bad = lambda i: i < 110 or 120 <= i < 122 or 122 <= i < 180 or i % 10 == 0
    labels = [(i, int(not bad(i)), 0) for i in range(len(hosts))]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    found = url_filter.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    verdict = {h.lower(): {r["verdict"] for r in found.filter(F.col("host") == h.lower()).collect()} for h in set(hosts)}
    assert verdict == {"user@bad.spam.com:8080": {"block"}, "bad.spam.com": {"block"}, "10.0.0.7": {"block"}, "new.fine.org": {"allow"}, "good.site.co.uk": {"allow"}, "ok.fine.org.": {"allow"}}
    levels = {r["name"]: (r["domain"], r["suffix"]) for r in found.select(url_filter.bare(F.col("host")).alias("name")).distinct().select("name", *(c.alias(n) for c, n in zip(url_filter.levels_of(F.col("name")), ("domain", "suffix")))).collect()}
    assert levels["10.0.0.7"] == ("10.0.0.7", "10.0.0.7") and levels["good.site.co.uk"] == ("site.co.uk", "co.uk") and levels["ok.fine.org"] == ("fine.org", "org")


def test_reputation_shrinks(spark):
    counts = [("bad.spam.com", 200, 190), ("new.spam.com", 2, 2), ("one.spam.com", 100, 96), ("good.site.com", 300, 6), ("new.site.com", 2, 2), ("fine.other.org", 500, 20)]
    rep = {r["host"]: r for r in url_filter.reputation(spark.createDataFrame(counts, "host string, n long, k long")).collect()}
    assert rep["bad.spam.com"]["lower"] > 0.8 and rep["good.site.com"]["mean"] < 0.1
    assert rep["new.spam.com"]["mean"] > rep["new.site.com"]["mean"] + 0.1


# -- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing(docs, no_docs, rows):
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    source = {(i, len(words(t))): s for i, t, s in rows}
    taken, largest = Counter(), Counter()
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert by_row(mixing.mix(docs)) == sorted((tuple(r) for r in found), key=repr)
    assert mixing.mix(no_docs).count() == 0 and mixing.take(no_docs).count() == 0
    many = mixing.take(docs)
    assert many.columns == docs.columns
    assert sum(len(words(r["text"])) for r in many.collect()) == sum(taken.values())


def test_rows_without_words_are_taken_at_most_three_times(spark):
    rows = [(i, "" if i % 2 else "a b", "s0") for i in range(40)] + [(i, "x " * 500, "s1") for i in range(40, 60)]
    many = Counter(r["doc_id"] for r in mixing.take(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert max(many.values()) <= 3 and many[0] >= 1


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5, None: 2}, {"a": 0, "b": 0}, {"a": 7}, {chr(97 + i): 3**i for i in range(9)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    expected = brute_targets(sizes)
    assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-6 for s in found)


def test_mixing_meets_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(0), F.col("id") % 50)).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    sums = mixing.mix(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    assert all(abs(r["t"] - r["g"]) <= 50 for r in sums.collect())


# -- training order


def test_training_order(spark, docs, no_docs, tmp_path):
    for n in (1, 2, 3, 100, 4097):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))
    place = f"file://{tmp_path}/order"
    about = training_order.materialise(docs, place, window=32, shard_bytes=4000)
    found = training_order.records(spark, place, about).orderBy("slot").collect()
    assert [r["slot"] for r in found] == list(range(about["sequences"])) and about["shards"] > 5
    at = Counter()
    for r in found:
        assert r["offset"] == 65 * at[r["shard"]] and len(r["data"]) == 64
        at[r["shard"]] += 1
    made = training_order.sequences(docs, None, 32, 2).orderBy("task", "place").collect()
    assert len(made) == about["sequences"]
    slots = training_order.feistel(np.arange(len(made)), len(made), about["key"]).tolist()
    assert sorted(slots) == list(range(len(made))) and slots != sorted(slots)
    assert [bytes(r["data"]) for r in found] == [bytes(made[slots.index(i)]["data"]) for i in range(len(made))]
    assert all(r["shard"] == r["slot"] // about["shard_records"] for r in found)
    plain = Tokenizer.from_file(tokens.default_path())
    ids = Counter(i for r in docs.collect() for i in [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    got = Counter(np.concatenate([np.frombuffer(bytes(r["data"]), "<u2")[: r["n_tokens"]] for r in made]).tolist())
    assert got == ids and 0 <= 32 * len(found) - ids.total() < 32 * docs.rdd.getNumPartitions()
    half = training_order.records(spark, place, about, first=13).collect()
    assert sorted((r["slot"], bytes(r["data"])) for r in half) == [(r["slot"], bytes(r["data"])) for r in found[13:]]
    some = [x.tobytes() for x in training_order.read_from(spark, place, about, 50, 100)]
    assert some == [bytes(r["data"]) for r in found[50:150]]
    assert training_order.training_order(no_docs).count() == 0
    with pytest.raises(Exception, match="doesn't fit 1 bytes"):
        training_order.sequences(docs, None, 32, 1).count()


def feistel_by_hand(x, n, key):
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    full = (1 << 64) - 1
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for r in range(training_order.ROUNDS):
            f = ((right ^ ((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & full)) * 0xBF58476D1CE4E5B9) & full
            f = ((f ^ (f >> 29)) * 0x94D049BB133111EB) & full
            left, right = right, left ^ ((f ^ (f >> 32)) & ((1 << half) - 1))
        x = (left << half) | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 70_000])
def test_feistel_by_hand(n):
    some = list(range(0, n, max(1, n // 300)))
    assert training_order.feistel(np.array(some), n, 99).tolist() == [feistel_by_hand(x, n, 99) for x in some]


# -- classifier


def test_classifier(spark, docs, no_docs, rows):
    good = [(i, " ".join(f"plain{(i * k) % 50} text" for k in range(1, 40)), 1) for i in range(300)]
    bad = [(i, " ".join(f"junk{(i * k) % 50}$$$ !!" for k in range(1, 40)), 0) for i in range(300, 400)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None), (9999, 1)], "doc_id long, quality int"))
    found = classifier.classify(table.drop("quality"), labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert held and all((r["score"] > 0.5) == (r["doc_id"] < 300) for r in held)
    assert [r["score"] for r in classifier.classify(table.drop("quality"), labels).orderBy("doc_id").collect()] == [r["score"] for r in sorted(found, key=lambda r: r["doc_id"])]
    odd = classifier.classify(docs, labels).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert classifier.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_ftrl_by_hand():
    rng = np.random.default_rng(8)
    z, n, model = defaultdict(float), defaultdict(float), classifier.Ftrl()

    def weight(i):
        if abs(z[i]) <= classifier.L1:
            return 0.0
        return -(z[i] - math.copysign(classifier.L1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2)

    for _ in range(300):
        at = rng.choice(40, 6, replace=False)
        x, y = rng.normal(size=6), float(rng.integers(0, 2))
        model.learn(at, x, y)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at.tolist(), x))))
        for i, v in zip(at.tolist(), x):
            g, w = (p - y) * v, weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA * w
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(40)), [weight(i) for i in range(40)]) and any(z.values())


def test_features_by_hand():
    text = "the cat, the cat!! the dog the cat, the"
    found = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", text)
    assert found == ["the", "cat", ",", "the", "cat", "!!", "the", "dog", "the", "cat", ",", "the"]
    places, x = classifier.features(text.encode())
    grams = Counter(found) + Counter(zip(found, found[1:]))
    values = sorted(math.log1p(c) for c in grams.values())
    norm = math.sqrt(sum(v * v for v in values))
    assert len(set(places.tolist())) == len(places) == 2 + len(grams)
    assert np.allclose(sorted(x[2:]), [v / norm for v in values])
    threes = list(zip(found, found[1:], found[2:]))
    assert x[0] == 1 and math.isclose(x[1], (len(threes) - len(set(threes))) / len(threes))


def test_a_labelled_doc_id_is_learned_from_once(spark):
    rows = [(1, "good words here"), (2, "bad $$$ words")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows * 50, "doc_id long, text string")
    assert classifier.train(once, labels) == classifier.train(many, labels)


# -- substring dedup


def brute_substring(rows, window):
    texts = [(i, words(t)) for i, t, _ in rows]
    count = Counter(tuple(w[s : s + window]) for _, w in texts for s in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "most"), [(35, 1000), (10, 1000), (10, 3), (10, 1), (35, 2)])
def test_substring_dedup(docs, rows, window, most):
    assert by_row(substring.substring_dedup(docs, window, most=most)) == brute_substring(rows, window)


def test_substring_of_large_groups(spark, monkeypatch):
    """Splitting large groups makes no table of more than two rows a stretch."""
    saved = []

    class Counted(Scratch):
        def save(self, df, by=None):
            out = super().save(df, by)
            saved.append((out.columns, out.count()))
            return out

    monkeypatch.setattr(substring, "Scratch", Counted)
    common = [f"c{i}" for i in range(120)]
    texts = [" ".join([f"x{i}_{k}" for k in range(20)] + common[:60] + [f"y{i}_{k}" for k in range(20)]) for i in range(150)]
    texts += [" ".join([*common[: i % 120], f"z{i}", *common[i % 120 + 1 :]]) for i in range(150)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert by_row(substring.substring_dedup(docs, most=20)) == brute_substring(rows, 35)
    at, stretches = next((i, n) for i, (columns, n) in enumerate(saved) if "first" in columns and "words" in columns)
    assert max(n for _, n in saved[at:]) <= 2 * stretches


def test_deep_nodes():
    found = substring.deep_nodes([(b"b", 1), (b"a", 2), (b"b", 3), (b"c", 4), (b"a", 5), (b"b", 6)])
    assert found == [[2, 5], [1, 3, 6]]


def test_substring_of_nothing(no_docs):
    assert substring.substring_dedup(no_docs).count() == 0


def test_spans(spark):
    w = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(w[:60])), (2, " ".join(["x", *w[10:50], "y"]))], "doc_id long, text string")
    _, found = substring.removed(docs)
    assert sorted([(s["start"], s["end"]) for s in r["spans"]] for r in found.collect()) == [[(1, 41)], [(10, 50)]]


# -- SimHash


def brute_fingerprint(text):
    w = [x.encode().lower().decode() for x in words(text)]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(len(fps)):
        members[find(i)].append(rows[i][0])
    least = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return [least[find(i)] for i in range(len(fps))]


def test_simhash(docs, no_docs, rows):
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    expected = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(rows, fps), strict=True)]
    assert by_row(simhash.near_dedup(docs)) == sorted(expected, key=repr)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    known = {c for c in (e[2] for e in expected) if c is not None}
    assert {r["doc_id"] for r in kept.collect()} - {None} == known
    assert kept.filter("doc_id IS NOT NULL").count() == len(known)
    assert simhash.near_dedup(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


@pytest.mark.parametrize(("cell", "grids"), [(256, simhash.GRIDS), (3, simhash.GRIDS), (2, (6, 7)), (1, (6,))])
def test_links_lose_none(spark, cell, grids):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(map(int, base))
    for b in base[:30]:
        for n in (1, 2, 3, 4):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    some = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    linked = simhash.links(spark.createDataFrame([(x,) for x in some], "fp long"), Scratch(spark, "links"), cell, grids)
    found = {(r["a"], r["b"]) for r in linked.collect()}
    assert found == {(a, b) for i, b in enumerate(some) for a in some[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_manhattan_distance_is_a_lower_bound():
    counts = lambda x: [(x >> i & 3).bit_count() for i in range(0, 64, 2)]
    rng = np.random.default_rng(6)
    for a, b in rng.integers(0, 2**63, (500, 2)).tolist():
        assert sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= (a ^ b).bit_count()
    for n in simhash.GRIDS:
        assert sum(simhash.group_masks(n)) == (1 << 64) - 1


@pytest.mark.parametrize("hub", [256, 1])
def test_components_of_a_chain(spark, hub):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (150, 200)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges, Scratch(spark, "chain"), hub).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}


# -- LM scoring


def test_lm(docs, no_docs, rows):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    texts = [(i, [w.encode().lower() for w in words(t)]) for i, t, _ in rows]
    count, ends = Counter(), 0
    for i, w in texts:
        if not held(i):
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    expected = []
    for i, w in texts:
        c = [count[x] for x in w] + [ends]
        expected.append((i, held(i), len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 6)))
    found = lm.score(docs)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found.collect())
    assert lm.score(no_docs).count() == 0


def brute_lm(rows, rare):
    """The score of each row, from one pass over everything in memory."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    texts = [(held(i), [w.encode().lower() for w in words(t)]) for i, t, _ in rows]
    count = Counter(w for h, t in texts if not h for w in t)
    frequent = sorted((w for w in count if count[w] * rare >= count.total()), key=lambda w: (-count[w], w))
    unit = {w: frequent.index(w) if w in frequent else len(frequent) + lm.shape(w) for _, t in texts for w in t}
    end, k = len(frequent) + lm.SHAPES, lm.CLASSES
    bigrams = Counter(x for h, t in texts if not h for x in zip([None, *t], [*t, None]))
    pairs = np.zeros((end + 1, end + 1))
    for (a, b), n in bigrams.items():
        pairs[unit.get(a, end), unit.get(b, end)] += n
    of = lm.exchange(pairs)
    assert of[end] == k
    cell = np.zeros((k + 1, k + 1))
    for a in range(end + 1):
        for b in range(end + 1):
            cell[of[a], of[b]] += pairs[a, b]
    beside = defaultdict(Counter)  # (class, whether it follows) of each word
    for (a, b), n in bigrams.items():
        beside[a][of[unit.get(b, end)], 1] += n
        beside[b][of[unit.get(a, end)], 0] += n
    first, second = cell.sum(1) + 1, cell.sum(0) + 1
    cls = {w: int(of[u]) for w, u in unit.items()}
    for w in count.keys() - set(frequent):
        was, value = cls[w], np.zeros(k)
        for (x, after), n in beside[w].items():
            chance = (second[x] if after else first[x]) * lm.PRIOR / (first.sum())
            for c in range(k):
                both, own = (cell[c, x] if after else cell[x, c]), cell[:, c].sum()
                if c == was:
                    both, own = max(both - n, 0), max(own - count[w], 0)
                value[c] += n * math.log((both + chance) / (own + lm.PRIOR))
        if value.max() > value[was] + 1e-9:
            cls[w] = int(value.argmax())
    final = np.zeros((k + 1, k + 1))
    for (a, b), n in bigrams.items():
        final[cls.get(a, k), cls.get(b, k)] += n
    types = Counter(cls[w] for w in count)
    ends, tokens_ = sum(not h for h, _ in texts), count.total() + sum(not h for h, _ in texts)
    kinds = len(count) + (ends > 0)
    seen = final.sum(0)
    out = []
    for _, t in texts:
        total, at = 0.0, k
        for w in [*t, None]:
            c, n = cls.get(w, k), ends if w is None else count[w]
            base = (n + 1) / (tokens_ + kinds + 1)
            step = (final[at, c] + lm.PRIOR * (seen[c] + 1) / (seen.sum() + k + 1)) / (final[at].sum() + lm.PRIOR)
            emitted = 1.0 if w is None else (n + 1) / (seen[c] + types[c] + 1)
            total += math.log10(lm.MIX * step * emitted + (1 - lm.MIX) * base)
            at = c
        out.append(total)
    return out


def test_lm_score_by_hand(docs, rows):
    expected = sorted(((r[0], len(words(r[1])) + 1, x) for r, x in zip(rows, brute_lm(rows, 200), strict=True)), key=lambda x: (x[0] is None, x))
    found = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in lm.score(docs, 200).collect()), key=lambda x: (x[0] is None, x))
    assert [x[:2] for x in found] == [x[:2] for x in expected]
    assert np.allclose([x[2] for x in found], [x[2] for x in expected], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("partitions", [1, 40])
def test_lm_score_does_not_depend_on_the_split(spark, docs, partitions):
    here = by_row(lm.score(docs, 200).select("doc_id", "n_tokens", F.round("score", 9)))
    assert by_row(lm.score(docs.repartition(partitions), 200).select("doc_id", "n_tokens", F.round("score", 9))) == here


def test_frequent_words_of_uneven_stretches(spark):
    ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    # 160,000 tokens: the limit is 80, and one in 16,000 of a stretch is 2.5
    texts = [["x"] * (75 if k == 0 else 2) + ["y"] * (75 if k == 0 else 1) for k in range(4)]
    texts = [" ".join(t + [f"f{k}-{i}" for i in range(40_000 - len(t))]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(zip(ids, texts)), 4), "doc_id long, text string")
    assert lm.frequent_words(docs) == lm.frequent_words(docs.coalesce(1)) == [b"x"]


def test_lm_clusters_rare_words_by_their_counts(spark):
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 7 != 2]
    some = [t for i in range(600) for t in (f"the wa{i:04d}kk is", f"very wb{i:04d}kk and")] * 2 + ["the dog is", "very big and"] * 100
    held = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = [t for i in range(100) for t in (f"the wa{i:04d}kk is", f"the wb{i:04d}kk is")]  # same counts, length and ending
    docs = spark.createDataFrame([*zip(ids, some), *zip(held, asked)], "doc_id long, text string").repartition(3)
    score = {r["doc_id"]: r["score"] for r in lm.score(docs).collect() if r["held_out"]}
    assert sum(score[a] > score[b] + 0.5 for a, b in zip(held[:200:2], held[1:200:2])) >= 95


def test_better_classes_make_neighbours_likeliest():
    rng = np.random.default_rng(5)
    pairs = rng.integers(40, 90, (5, 5))
    pairs += pairs.T  # a class is as often first as second
    q = (pairs.sum(0) + 1) / (pairs.sum() + 5)
    group, near, n, was, total, expected = [], [], [], [], [], []
    for w in range(1200):
        was.append(w % 4)
        total.append(w % 9)
        sides = [rng.multinomial(total[w], np.full(5, 0.2)) for _ in range(2)]
        value = np.zeros(4)
        for side, r in enumerate(sides):
            for x in np.flatnonzero(r):
                group.append(w), near.append(5 * side + x), n.append(r[x])
                for c in range(4):
                    less, of = (r[x], total[w]) if c == was[w] else (0, 0)
                    cell = pairs[x, c] if side == 0 else pairs[c, x]
                    value[c] += r[x] * math.log((cell - less + lm.PRIOR * q[x]) / (pairs[c].sum() - of + lm.PRIOR))
        expected.append(int(value.argmax()) if total[w] else was[w])
    assert lm.better_classes(*(np.array(a) for a in (group, near, n, was, total)), pairs).tolist() == expected


def test_exchange_finds_classes():
    rng = np.random.default_rng(3)
    n = np.zeros((21, 21))
    for _ in range(20_000):  # words 0-9 are followed by 10-19, and those by 0-9
        a = rng.integers(0, 10)
        n[a, 10 + rng.integers(0, 10)] += 1
        n[10 + rng.integers(0, 10), a] += 1
    of = lm.exchange(n, classes=2)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 2


def test_model_is_a_distribution():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 30, (12, 12)).astype(float)
    model = lm.fit(pairs, np.r_[np.ones(11, int), 0], [], classes=3)
    assert np.allclose(model.transition.sum(1), 1, atol=0.02)
