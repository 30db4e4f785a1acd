"""Quality rules: a threshold table compiled into one projection.

Each rule of the table bounds a ratio of two counts of a text. The counts are
native expressions over the whole text; the table becomes one boolean column,
so the whole operator is a narrow projection without a shuffle.

Edge cases: a null or empty text has no words, so every count is 0 and the base
rule rejects it; repeated rows are judged one by one; an empty table gives an
empty result; columns of the input are passed through whatever their names, only
``judge`` replaces those called ``measures``, ``base_failed`` and ``kept``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE_CHARS, columns_of, free_names, text_of, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was with as be on by at from this are or an he they have not "
    "le la les de des du et un une est que qui dans en au aux pour sur par ne pas plus "
    "der die das und zu den dem ein eine ist von mit im auf nicht sich auch als an werden "
    "el los las y del por con una su para al lo como se es no"
).split()

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """Rejects when ``100 * part > most * whole`` or ``100 * part < least * whole``."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: Every whole is positive where the base rule holds, as that asks for 50 words.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=2000),
    Rule("symbols", "n_symbols", "n_words", most=30),
    Rule("shouting", "n_emphasis", "n_words", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=60),
)
#: A place of a text's windows fits this many bits, as a text has fewer than 2 ** 31 bytes.
PLACE_BITS = 31
MOST_PLACE = (1 << PLACE_BITS) - 1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(df: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """Adds ``measures``, a struct with every count that the rules use.

    Repeated words: the hashes of the three-word windows, each above the
    window's place in one number, are sorted as plain numbers; windows that
    share a hash with a neighbour are the only ones that can occur twice. These
    are sorted by their words, equal neighbours give the places of windows found
    twice or more, and the union of the covered places is counted from their
    sorted gaps.
    """
    t = text_of(text)
    w, codes, grams, places, lines = free_names(df, "_q_w", "_q_codes", "_q_grams", "_q_places", "_q_lines")
    n = F.size(w)
    a = df.withColumn(w, words_of(t)).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0))

    def window(i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    a = a.withColumn(codes, F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(*window(i)), PLACE_BITS).bitwiseOR(i.cast("long"))))))
    c = F.col(codes)

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y).between(0, MOST_PLACE), F.lit(False))

    likely = F.filter(c, lambda x, i: same(x, F.get(c, i - 1)) | same(x, F.get(c, i + 1)))
    place = F.transform(likely, lambda x: x.bitwiseAND(F.lit(MOST_PLACE)).cast("int"))
    a = a.withColumn(grams, F.sort_array(F.transform(place, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("i")))))
    g = F.col(grams)
    found = F.transform(g, lambda x, i: F.when((x["g"] == F.get(g, i - 1)["g"]) | (x["g"] == F.get(g, i + 1)["g"]), x["i"]))
    a = a.withColumn(places, F.sort_array(F.array_compact(found)))
    p = F.col(places)
    gaps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))).cast("long"))
    repeat = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long"))
    measures = F.struct(
        n.cast("long").alias("n_words"),
        (F.length(F.translate(t, SPACE_CHARS, ""))).cast("long").alias("word_chars"),
        _count_chars(t, SYMBOLS).alias("n_symbols"),
        _count_chars(t, "!").alias("n_emphasis"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
    )
    return a.withColumn(name, measures).drop(w, codes, grams, places, lines)


def base_failed(measures: Column) -> Column:
    return (measures["n_words"] < MIN_WORDS) | (100 * measures["n_repeat_words"] > MAX_REPEAT_PERCENT * measures["n_words"])


def rejected(measures: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules compiled into one boolean expression."""
    out = F.lit(False)
    for r in rules:
        if r.most is not None:
            out = out | (100 * measures[r.part] > r.most * measures[r.whole])
        if r.least is not None:
            out = out | (100 * measures[r.part] < r.least * measures[r.whole])
    return out


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``measures``, ``base_failed`` and ``kept``; columns of these names are replaced."""
    out = measure(df.drop("measures", "base_failed", "kept"), text)
    m = F.col("measures")
    return out.withColumn("base_failed", base_failed(m)).withColumn("kept", ~F.col("base_failed") & ~rejected(m, rules))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that are kept, with their own columns.

    The row number in the condition keeps the planner from moving the filter
    below the measures, which would copy their expressions into it many times.
    """
    name, row = free_names(df, "measures", "_q_row")
    out = measure(df, text, name).withColumn(row, F.monotonically_increasing_id())
    m = F.col(name)
    return out.filter(~base_failed(m) & ~rejected(m, rules) & (F.col(row) >= 0)).select(*columns_of(df))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB twin of the query, from the same table."""
    bad = ["n_words < %d" % MIN_WORDS, "100 * n_repeat_words > %d * n_words" % MAX_REPEAT_PERCENT]
    own = [f"100 * {r.part} > {r.most} * {r.whole}" for r in rules if r.most is not None] + [f"100 * {r.part} < {r.least} * {r.whole}" for r in rules if r.least is not None]
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = r"'[\x20\x09-\x0D]+'"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, {space}), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
    c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
    p AS (SELECT DISTINCT rid, i + k AS place FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
    r AS (SELECT rid, count(*) AS n_repeat_words FROM p GROUP BY rid),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, {space}, '', 'g'))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (length(t) - length(replace(t, '!', '')))::BIGINT AS n_emphasis,
                 len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
                 len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN r USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({" OR ".join(bad)}) AS base_failed, NOT ({" OR ".join(bad + own)}) AS kept
    FROM m"""
