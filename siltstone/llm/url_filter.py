"""URL filters: rules by host and path, and reputation by empirical Bayes.

Pages with a label give each host counts of bad outcomes. The rate of a suffix
is shrunk to the overall rate, that of a registered domain to its suffix's and
that of a host to its domain's, each by a beta-binomial prior whose strength is
estimated from the spread of its level (method of moments). A host is blocked
if the lower bound of its posterior odds is above ``ODDS`` times the overall
odds, so what counts as bad follows the labels, and a host with few outcomes is
judged mostly by what stands above it.

For the levels a host loses user info, port and closing dots; an address is its
own domain and suffix. Suffixes are the last label, or one of the caller's list
of longer ones; ``LONG_SUFFIXES`` is a short excerpt of the public list, which a
deployment passes in whole.

Counts are partially aggregated by host before they are shuffled; later levels
work on one row per host. Verdicts are joined back by host with a plain
exchange on each side, so a hot host is split at run time.

Edge cases: a url that is null or lacks "://" has an empty host and path; a
label counts for every page with its id, and of several labels the worst; pages
without label only receive; without any label the rate is one half and nothing
is blocked by reputation; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, UPPER, Scratch, ascii_lower

#: (verdict, rule): host, then the path's beginning.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels, beside those of one.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br")
#: A host is bad if its odds are surely (one-sided, 95 %) so many times those of all pages.
ODDS = 2.0
SIGMAS = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: str) -> Column:
    of, slash, beginning = rule.partition("/")
    return ((host == of) | host.endswith("." + of)) & path.startswith(slash + beginning)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are a policy of the caller, compiled into the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        fits = _fits(host, path, r)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def bare(host: Column) -> Column:
    """The host's name: without user info, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^(?:[^@]*@)+", ""), r"(?::[0-9]*|\.+)+\z", "")


def levels_of(name: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix): the suffix is the last label, or the last two where listed; an address is both."""
    two = F.substring_index(name, ".", -2)
    long = two.isin(*long_suffixes)
    address = name.rlike(r"^[0-9.]+\z|^\[")
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, name).when(long, two).otherwise(F.substring_index(name, ".", -1))


def strength(counts: DataFrame) -> DataFrame:
    """One row: the prior's strength from the spread of rates over groups with n > 0 outcomes, k of them bad."""
    some = counts.filter("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("m"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"))
    p = F.col("k") / F.col("n")
    chance = (F.col("m") - 1) / F.col("n")
    spread = (F.col("q") / F.col("n") - p * p) / (p * (1 - p))
    rho = (spread - chance) / (1 - chance)
    known = (F.col("n") > F.col("m")) & (F.col("k") > 0) & (F.col("k") < F.col("n"))
    m = F.when(known & (rho > 0), (1 - rho) / rho).otherwise(F.lit(MOST_STRENGTH))
    return some.select(F.round(F.least(F.greatest(m, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), 6).alias("strength"))


def reputation(outcomes: DataFrame, odds: float = ODDS, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """Rows (host, n, k) of counts by host to host, mean, lower (the lower bound of the posterior rate) and bad."""
    s = Scratch(outcomes.sparkSession, "hosts")
    domain, suffix = levels_of(F.col("host"), long_suffixes)
    hosts = s.save(outcomes.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = s.save(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = s.save(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    rate = (total["k"] + 1) / (total["n"] + 2)
    # a number for each level is all that the driver reads
    m_suffix, m_domain, m_host = (t.first()[0] for t in (strength(suffixes), strength(domains), strength(hosts)))
    suffixes = suffixes.select("suffix", ((F.col("k") + m_suffix * rate) / (F.col("n") + m_suffix)).alias("above"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("k") + m_domain * F.col("above")) / (F.col("n") + m_domain)).alias("above"))
    a, b = F.col("k") + m_host * F.col("above"), F.col("n") - F.col("k") + m_host * (1 - F.col("above"))
    mean = a / (a + b)
    lower = mean - SIGMAS * F.sqrt(mean * (1 - mean) / (a + b + 1))
    bad = lower * (1 - rate) > odds * rate * (1 - lower)
    return s.save(hosts.join(domains, ["domain", "suffix"]).select("host", mean.alias("mean"), lower.alias("lower"), bad.alias("bad")))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, odds: float = ODDS, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url").cast("string"))
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("name", bare(F.col("host")))
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    outcomes = own.select("page_id", F.col("name").alias("host")).join(bad, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    verdicts = reputation(outcomes, odds, long_suffixes).select(F.col("host").alias("name"), "bad")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return own.join(verdicts, "name", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    def case(what: int) -> str:
        when = []
        for x in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
            of, _, beginning = x[1].partition("/")
            when.append(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{beginning}') THEN '{x[what]}'")
        return f"CASE {' '.join(when)} END"

    def strength(of: str) -> str:
        return f"""(SELECT round(least(greatest(CASE WHEN n > m AND k > 0 AND k < n AND rho > 0 THEN (1 - rho) / rho ELSE {MOST_STRENGTH} END, {LEAST_STRENGTH}), {MOST_STRENGTH}), 6) FROM (
            SELECT *, CASE WHEN n > m AND k > 0 AND k < n THEN ((q / n - (k / n) * (k / n)) / ((k / n) * (1 - k / n)) - (m - 1) / n) / (1 - (m - 1) / n) END AS rho FROM (
            SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*)::DOUBLE AS m, sum(k * k / n) AS q FROM {of} WHERE n > 0)))"""

    longs = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    q AS (SELECT *, regexp_replace(regexp_replace(host, '^(?:[^@]*@)+', ''), '(?::[0-9]*|\\.+)+\\z', '') AS name FROM p),
    l AS (SELECT doc_id AS page_id, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels GROUP BY doc_id),
    h AS (SELECT name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, array_to_string(string_split(name, '.')[-2:], '.') AS two,
                 regexp_matches(name, '^[0-9.]+\\z|^\\[') AS address FROM q LEFT JOIN l USING (page_id) GROUP BY name),
    hosts AS (SELECT name, n, k, CASE WHEN address THEN name WHEN two IN ({longs}) THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
                     CASE WHEN address THEN name WHEN two IN ({longs}) THEN two ELSE string_split(name, '.')[-1] END AS suffix FROM h),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
    c AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS rate, {strength("suffixes")} AS ms, {strength("domains")} AS md, {strength("hosts")} AS mh FROM suffixes),
    s AS (SELECT suffix, (k + ms * rate) / (n + ms) AS above FROM suffixes, c),
    d AS (SELECT domain, suffix, (k + md * above) / (n + md) AS above FROM domains JOIN s USING (suffix), c),
    b AS (SELECT name, rate, k + mh * above AS a, n - k + mh * (1 - above) AS b FROM hosts JOIN d USING (domain, suffix), c),
    w AS (SELECT name, rate, a / (a + b) - {SIGMAS} * sqrt(a * b / (a + b) / (a + b) / (a + b + 1)) AS lower FROM b),
    v AS (SELECT name, lower * (1 - rate) > {ODDS} * rate * (1 - lower) AS bad FROM w)
    SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
    FROM q LEFT JOIN v USING (name)"""
