import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, h long, size long, key string, measures string, rid int, blk int, _q_row long, __plan string, __near_id long, `a.b` string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Rows (doc_id, text, source) with nulls, empty and blank texts, copies, near copies, repeated rows and a long text."""
    rng = random.Random(7)
    prose = [sentence(rng, rng.randint(1, 200)) for _ in range(40)]
    passage = sentence(rng, 60)
    texts = [None, "", " \t\n ", "one", "Two words", "the  the\tthe\nthe", *prose]
    texts += [prose[3], prose[3].replace(" ", "\n\t", 2), prose[3] + " ", prose[4] + " end", prose[5].upper()]
    texts += [f"{prose[i]} {passage} {prose[i + 1]}" for i in range(6)] + [passage, passage + " x"]
    texts += ["again and again " * 60, "la\nla\nla\n\nlo\n", "#* $% &| <> !", "x" * 5000, " ".join(prose) * 12, "a <|endoftext|> B", "\u00c9t\u00c9 \u1e96 I\u0307"]
    found = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    found += [found[7], found[7], (None, prose[8], "s1"), (None, None, None), (None, prose[8], "s1")]
    return found


def frame(spark, rows, partitions=3):
    data = [(i, t, None, s, None if t is None else len(t), "n", 1, 2, "k", f"m{k}", 3, 4, k, f"p{k}", -k, f"d{k}") for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """As a table of files, with columns whose names clash with those inside the operators."""
    place = f"{tmp_path_factory.mktemp('docs')}/documents.parquet"
    frame(spark, rows).write.parquet(place)
    return spark.read.parquet(place)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
