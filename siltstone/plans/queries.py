"""One query per operator of the engine, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import bloom_math, codec
from siltstone.functions.bloom_math import BloomParams
from siltstone.operators import bloom, capacity, compaction, fold, lookup, pages, txn
from siltstone.plans.frames import LOG_SQL, SEGMENTS_SQL, customers, event_log, order_segments, table
from siltstone.schema import RECORD_TYPES, KeyRange
from siltstone.sources import log as log_source
from siltstone.sources import segment
from siltstone.sources.scratch import scratch_root, stored
from siltstone.streaming import ingest
from siltstone.table import KeyedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def text(df: DataFrame, *columns: str) -> DataFrame:
    """Binary columns as text, for comparison."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("value",)})


# -- point and batch reads


@register("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000042'")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(lookup.get(customers(spark, sf_dir), "Customer#000000042"))


_ASKED = "asked AS (SELECT 'Customer#' || lpad((s_suppkey * 37)::VARCHAR, 9, '0') AS key FROM supplier)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 37).cast("string"), 9, "0")).alias("key"))


@register(f"WITH {_ASKED} SELECT key, c_mktsegment AS value FROM asked LEFT JOIN customer ON key = c_name")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(lookup.multi_get(customers(spark, sf_dir), _asked(spark, sf_dir)))


@register(f"WITH {_ASKED} SELECT key, EXISTS (SELECT 1 FROM customer WHERE c_name = key) AS found FROM asked")
def contains_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.contains(customers(spark, sf_dir), _asked(spark, sf_dir))


# -- ordered ranges, with the position in key order

_LOW, _HIGH = "Customer#000000030", "Customer#000000090"
_RANGES = {
    "range_half_open": (KeyRange.half_open(_LOW, _HIGH), f"c_name >= '{_LOW}' AND c_name < '{_HIGH}'"),
    "range_inclusive": (KeyRange.closed(_LOW, _HIGH), f"c_name BETWEEN '{_LOW}' AND '{_HIGH}'"),
    "range_from": (KeyRange.starting_at(_LOW), f"c_name >= '{_LOW}'"),
    "range_to": (KeyRange.up_to(_HIGH), f"c_name < '{_HIGH}'"),
    "range_excl_excl": (KeyRange.exclusive(_LOW, _HIGH), f"c_name > '{_LOW}' AND c_name < '{_HIGH}'"),
    "range_full": (KeyRange.full(), "true"),
    "range_empty": (KeyRange.half_open(_LOW, _LOW), "false"),
}
for _name, (_keys, _where) in _RANGES.items():
    register(f"SELECT c_name AS key, c_mktsegment AS value, row_number() OVER (ORDER BY c_name) AS position FROM customer WHERE {_where}", _name)(lambda spark, sf_dir, keys=_keys: text(lookup.ranked(customers(spark, sf_dir), keys)))


@register("SELECT o_orderkey AS key, o_orderpriority AS value, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def range_integer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return lookup.ranked(o, KeyRange.closed(100, 5000))


# -- sizes and capacity


@register("SELECT count(*) AS len, count(*) = 0 AS is_empty FROM customer")
def table_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.length(customers(spark, sf_dir))


@register("SELECT sum(strlen(c_name) + strlen(c_mktsegment) + 32)::BIGINT AS size_bytes, 100000::BIGINT AS max_capacity, sum(strlen(c_name) + strlen(c_mktsegment) + 32) >= 100000 AS is_full FROM customer")
def table_size_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.size_bytes(customers(spark, sf_dir), 100_000)


@register("SELECT doc_id, strlen(lang)::BIGINT + 8 AS key_bytes, strlen(text)::BIGINT + 16 AS value_bytes, strlen(lang)::BIGINT + strlen(text)::BIGINT + 32 AS entry_bytes FROM documents")
def byte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", codec.key_size(F.col("lang")).alias("key_bytes"), codec.value_size(value).alias("value_bytes"), codec.entry_size(F.col("lang"), value).alias("entry_bytes"))


@register(f"""WITH {LOG_SQL}, d AS (SELECT lsn, key, CASE WHEN op = 'PUT' THEN strlen(key) + strlen(value) + 32 ELSE 0 END AS s FROM log WHERE op IN ('PUT', 'DEL')),
x AS (SELECT lsn, key, s - coalesce(lag(s) OVER (PARTITION BY key ORDER BY lsn), 0) AS delta FROM d)
SELECT key::BIGINT % 16 AS shard, lsn, delta::BIGINT AS delta, sum(delta) OVER (PARTITION BY key::BIGINT % 16 ORDER BY lsn)::BIGINT AS size_bytes FROM x""")
def capacity_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("shard", F.col("key").cast("long") % 16)
    return capacity.trace(log, "shard")


@register("""WITH RECURSIVE p AS (SELECT conv_id, turn AS lsn, role AS key, strlen(role) + strlen(text) + 32 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, 0::BIGINT AS lsn, 0::BIGINT AS n, false AS accepted, 0::BIGINT AS total, MAP {}::MAP(VARCHAR, BIGINT) AS sizes FROM (SELECT DISTINCT conv_id FROM p)
  UNION ALL SELECT p.conv_id, p.lsn, p.n, total - coalesce(sizes[p.key], 0) + p.size <= 400,
    CASE WHEN total - coalesce(sizes[p.key], 0) + p.size <= 400 THEN total - coalesce(sizes[p.key], 0) + p.size ELSE total END,
    CASE WHEN total - coalesce(sizes[p.key], 0) + p.size <= 400 THEN map_concat(sizes, MAP {p.key: p.size::BIGINT}) ELSE sizes END
  FROM r JOIN p ON p.conv_id = r.conv_id AND p.n = r.n + 1)
SELECT conv_id, lsn, accepted, total AS size_bytes FROM r WHERE n > 0""")
def capacity_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a table of 400 bytes, keyed by role; its turns are inserts in order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("lsn"), F.col("role").alias("key"), F.col("text").cast("binary").alias("value"))
    return capacity.admit(c, 400, "conv_id")


# -- folds of the log

_LAST = "SELECT key, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM {0} WHERE op IN ('PUT', 'DEL') {1} GROUP BY key HAVING arg_max(op, lsn) = 'PUT'"
_CLEARED = "AND lsn > (SELECT coalesce(max(lsn), -1) FROM {0} WHERE op = 'CLEAR')"


def _last(source: str, cleared: bool = True, more: str = "") -> str:
    return _LAST.format(source, (_CLEARED.format(source) if cleared else "") + more)


@register(f"WITH {LOG_SQL} {_last('log', False)}")
def lww_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(fold.last_writes(event_log(spark, sf_dir).filter(F.col("op").isin("PUT", "DEL"))).filter("op = 'PUT'").select("key", "value", "lsn"))


@register(f"WITH {LOG_SQL} {_last('log')}")
def clear_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(fold.replay(event_log(spark, sf_dir), transactional=False))


@register(f"WITH {LOG_SQL} {_last('com')}")
def txn_committed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(fold.replay(stored(event_log(spark, sf_dir), "log")))


#: Three quarters of the log, past both of its CLEARs on larger tables.
_AS_OF = "(SELECT 3 * max(lsn) // 4 FROM log)"


@register(f"""WITH {LOG_SQL}, upto AS (SELECT * FROM log WHERE lsn <= {_AS_OF}),
dn AS (SELECT txn_id FROM upto WHERE txn_id <> 0 AND op IN ('COMMIT', 'ABORT') GROUP BY txn_id HAVING arg_max(op, lsn) = 'COMMIT'),
cm AS (SELECT * FROM upto WHERE txn_id = 0 OR txn_id IN (SELECT txn_id FROM dn)) {_last('cm')}""")
def as_of_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stored(event_log(spark, sf_dir), "log")
    return text(fold.replay(log, upto_lsn=3 * (log.agg(F.max("lsn")).first()[0] or 0) // 4))


_OLD = f"""WITH {LOG_SQL}, c AS (SELECT *, (SELECT count(*) FROM log x WHERE x.op = 'CLEAR' AND x.lsn < log.lsn) AS epoch FROM log WHERE op IN ('PUT', 'DEL')),
o AS (SELECT lsn, op, key, value, CASE WHEN lag(op) OVER w = 'PUT' THEN lag(value) OVER w END AS old_value FROM c WINDOW w AS (PARTITION BY key, epoch ORDER BY lsn))"""


@register(f"{_OLD} SELECT lsn, key, value, old_value FROM o WHERE op = 'PUT'")
def upsert_old_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(fold.old_values(event_log(spark, sf_dir)).filter("op = 'PUT'").drop("op"), "value", "old_value")


@register(f"{_OLD} SELECT lsn, key, old_value FROM o WHERE op = 'DEL'")
def remove_returns_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(fold.old_values(event_log(spark, sf_dir)).filter("op = 'DEL'").select("lsn", "key", "old_value"), "old_value")


@register(f"WITH {LOG_SQL} SELECT lsn, key, row_number() OVER w - 1 AS generation, lead(lsn) OVER w IS NOT NULL AS is_stale FROM log WHERE op IN ('PUT', 'DEL') WINDOW w AS (PARTITION BY key ORDER BY lsn)")
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.generations(event_log(spark, sf_dir))


# -- transactions


@register(f"""WITH {LOG_SQL} SELECT txn_id, CASE arg_max(op, lsn) FILTER (op IN ('BEGIN', 'PREPARE', 'COMMIT', 'ABORT')) WHEN 'BEGIN' THEN 'STARTED' WHEN 'PREPARE' THEN 'PREPARED' WHEN 'COMMIT' THEN 'COMMITTED' WHEN 'ABORT' THEN 'ABORTED' END AS status,
min(lsn) AS began, max(lsn) FILTER (op IN ('COMMIT', 'ABORT')) AS ended, count(*) FILTER (op NOT IN ('BEGIN', 'PREPARE', 'COMMIT', 'ABORT')) AS operations FROM log WHERE txn_id <> 0 GROUP BY txn_id""")
def txn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.transaction_status(event_log(spark, sf_dir))


_LATE = "SELECT lsn + 1000000000 AS lsn, op, key, value, id, txn_id FROM log WHERE txn_id % 4 = 1 AND op IN ('PUT', 'PREPARE', 'COMMIT')"


@register(f"""WITH {LOG_SQL}, a AS (SELECT * FROM log UNION ALL {_LATE}),
s AS (SELECT lsn, txn_id, op, coalesce(first_value(CASE WHEN op IN ('COMMIT', 'ABORT') THEN op END IGNORE NULLS) OVER w, last_value(CASE WHEN op IN ('BEGIN', 'PREPARE', 'COMMIT', 'ABORT') THEN op END IGNORE NULLS) OVER w) AS before FROM a WHERE txn_id <> 0
  WINDOW w AS (PARTITION BY txn_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT lsn, txn_id, op, CASE WHEN before IS NULL AND op <> 'BEGIN' THEN 'TransactionNotFound' WHEN before IS NOT NULL AND op = 'BEGIN' THEN 'TransactionAlreadyExists' WHEN before = 'COMMIT' THEN 'TransactionAlreadyCommitted' WHEN before = 'ABORT' THEN 'TransactionAlreadyAborted'
  WHEN before = 'PREPARE' AND op = 'PREPARE' THEN 'TransactionAlreadyPrepared' WHEN before = 'PREPARE' AND op NOT IN ('BEGIN', 'PREPARE', 'COMMIT', 'ABORT') THEN 'TransactionWrongState' END AS error FROM s)
SELECT * FROM v WHERE error IS NOT NULL""")
def txn_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the transactions try to go on after their end, or after they are prepared."""
    log = event_log(spark, sf_dir)
    late = log.filter((F.col("txn_id") % 4 == 1) & F.col("op").isin("PUT", "PREPARE", "COMMIT")).withColumn("lsn", F.col("lsn") + 1_000_000_000)
    return txn.violations(log.unionByName(late))


# -- checkpoints and recovery

_MIDDLE = "(SELECT max(lsn) FROM log WHERE op = 'CHECKPOINT_START' AND id = (SELECT 1 + (count(*) - 1) // 2 FROM log WHERE op = 'CHECKPOINT_START'))"


def _middle(log: DataFrame) -> int:
    """LSN of the middle checkpoint. A number that the driver needs to plan, as a manifest would tell it."""
    n = log.filter("op = 'CHECKPOINT_START'").count()
    return log_source.checkpoint_lsn(log, 1 + (n - 1) // 2)


@register(f"WITH {LOG_SQL} SELECT id, max(lsn) FILTER (op = 'CHECKPOINT_START') AS start_lsn, max(lsn) FILTER (op = 'CHECKPOINT_END') AS end_lsn FROM log WHERE op IN ('CHECKPOINT_START', 'CHECKPOINT_END') GROUP BY id")
def checkpoint_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_log(spark, sf_dir).filter(F.col("op").isin("CHECKPOINT_START", "CHECKPOINT_END"))
    return c.groupBy("id").agg(F.max(F.when(F.col("op") == "CHECKPOINT_START", F.col("lsn"))).alias("start_lsn"), F.max(F.when(F.col("op") == "CHECKPOINT_END", F.col("lsn"))).alias("end_lsn"))


@register(f"WITH {LOG_SQL} SELECT lsn, op, key, value, id, txn_id FROM log WHERE lsn > {_MIDDLE}")
def checkpoint_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return text(log_source.tail(log, _middle(log)))


@register(f"WITH {LOG_SQL} {_last('com')}")
def recover_snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at the middle checkpoint, then the log's tail over it; log, snapshot and tail are tables, as they are on disk."""
    log = stored(event_log(spark, sf_dir), "log")
    at = _middle(log)
    snapshot = stored(fold.replay(log, upto_lsn=at), "snapshot")
    return text(fold.replay(stored(fold.tail_of(log, at), "tail"), snapshot))


# -- Bloom filters

_H = "('0x' || substr(md5('{0}' || {1}), 1, 12))::BIGINT"
_GRID = "g(n, p) AS (VALUES (0, 0.01), (1, 0.5), (100, 0.01), (1000, 0.01), (1000, 0.05), (10000, 0.001), (50000000, 0.01), (1000, 0.0), (1000, 1.5))"


@register(f"""WITH {_GRID}, c AS (SELECT n, p::DOUBLE AS p, least(greatest(n, 1), 10000000)::DOUBLE AS cn, CASE WHEN p > 0 AND p < 1 THEN p::DOUBLE ELSE 0.01 END AS cp FROM g),
b AS (SELECT *, least(ceil(-cn * ln(cp) / pow(ln(2), 2)), 100000000)::BIGINT AS bits FROM c) SELECT n::BIGINT AS n, p, bits, least(greatest(ceil(bits / cn * ln(2)), 1), 20)::BIGINT AS hashes FROM b""")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [(0, 0.01), (1, 0.5), (100, 0.01), (1000, 0.01), (1000, 0.05), (10_000, 0.001), (50_000_000, 0.01), (1000, 0.0), (1000, 1.5)]
    df = spark.createDataFrame(grid, "n long, p double")
    c = bloom_math.params_columns(F.col("n"), F.col("p"))
    return df.withColumn("bits", c["bits"]).withColumn("hashes", bloom_math.params_columns(F.col("n"), F.col("p"))["hashes"])


@register("SELECT n::BIGINT AS n, round(pow(1 - exp(-7 * n / 9586.0), 7), 9) AS rate FROM (SELECT unnest([0, 1, 500, 1000, 2000, 10000]) AS n)")
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(n,) for n in (0, 1, 500, 1000, 2000, 10_000)], "n long")
    p = BloomParams.of(1000, 0.01)
    return df.select("n", F.round(bloom_math.rate_column(F.col("n"), F.lit(float(p.bits)), F.lit(p.hashes)), 9).alias("rate"))


def _params(spark: SparkSession, sf_dir: str, partitions: int = 1) -> BloomParams:
    """Of a filter for all customers; their count is read from the files' footers."""
    n = table(spark, sf_dir, "customer").count()
    return BloomParams.partitioned(n, 0.01, partitions) if partitions > 1 else BloomParams.of(n, 0.01)


def _sized(partitions: int) -> str:
    """The same in SQL: a row of bits and hashes."""
    return f"""(SELECT bits, least(greatest(ceil(bits / n * ln(2)), 1), 20)::BIGINT AS hashes FROM (
    SELECT n, ceil(-n * ln(0.01) / pow(ln(2), 2))::BIGINT AS bits FROM (SELECT greatest(ceil(count(*) / {partitions}.0), 1)::DOUBLE AS n FROM customer)))"""


def _positions(items: str, partitions: int, source: str) -> str:
    part = f"({_H.format('p', items)} % {partitions})::INT" if partitions > 1 else "0"
    return f"SELECT {items} AS key, {part} AS part, ({_H.format('a', items)} + i * ({_H.format('b', items)} | 1)) % bits AS pos FROM {source}, {_sized(partitions)} z, range(20) r(i) WHERE i < hashes"


def _probe_sql(partitions: int) -> str:
    built, asked = _positions("c_name", partitions, _FIRST), _positions("c_name", partitions, "customer")
    return f"""b AS (SELECT DISTINCT part, pos FROM ({built})), q AS ({asked}), probed AS (SELECT q.key, count(b.pos) = (SELECT hashes FROM {_sized(partitions)} z) AS may_contain FROM q LEFT JOIN b ON q.part = b.part AND q.pos = b.pos GROUP BY q.key)"""


_PARTS = 4
_FIRST = "(SELECT * FROM customer WHERE c_custkey % 2 = 0)"


def _even(spark: SparkSession, sf_dir: str, rest: int = 0) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == rest).select(F.col("c_name").alias("key"))


def _everyone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))


@register(f"SELECT 0 AS part, count(DISTINCT pos) AS bits_set FROM ({_positions('c_name', 1, _FIRST)})")
def bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.set_bits(bloom.build(_even(spark, sf_dir), _params(spark, sf_dir)))


@register(f"WITH {_probe_sql(1)} SELECT key, may_contain FROM probed")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir)
    return bloom.probe(_everyone(spark, sf_dir), bloom.build(_even(spark, sf_dir), p), p)


@register(f"SELECT 0 AS part, count(DISTINCT pos) AS bits_set FROM ({_positions('c_name', 1, 'customer')})")
def bloom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir)
    return bloom.set_bits(bloom.merge(bloom.build(_even(spark, sf_dir), p), p, bloom.build(_even(spark, sf_dir, 1), p), p))


@register(f"WITH {_probe_sql(_PARTS)} SELECT c_custkey AS place, key, may_contain FROM probed JOIN customer ON key = c_name")
def bloom_partitioned_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir, _PARTS)
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("key"))
    return bloom.probe_batch(asked, bloom.build(_even(spark, sf_dir), p), p).select("place", "key", "may_contain")


@register(f"WITH {_probe_sql(_PARTS)} SELECT coalesce(bool_or(may_contain), false) AS any_hit, coalesce(bool_and(may_contain), true) AS all_hit FROM probed")
def bloom_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir, _PARTS)
    return bloom.any_all(bloom.probe(_everyone(spark, sf_dir), bloom.build(_even(spark, sf_dir), p), p))


# -- segments and compaction


@register(f"WITH {SEGMENTS_SQL} SELECT key, arg_max(value, seq) FILTER (NOT tombstone) AS value FROM seg GROUP BY key HAVING NOT arg_max(tombstone, seq)")
def sstable_compact_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(compaction.merge(order_segments(spark, sf_dir), drop_tombstones=True).select("key", "value"))


@register(f"WITH {SEGMENTS_SQL}, s AS (SELECT * FROM seg WHERE seq > 0), m AS (SELECT key, max(seq) AS seq FROM s GROUP BY key) SELECT key, value, tombstone FROM s JOIN m USING (key, seq)")
def compact_keeps_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge of the newer segments only keeps deletes, as an older segment may have the key."""
    return text(compaction.merge(order_segments(spark, sf_dir)[1:]).select("key", "value", "tombstone"))


@register("""WITH RECURSIVE i AS (SELECT lang, source, sum(strlen(text))::BIGINT AS size FROM documents GROUP BY lang, source),
j AS (SELECT lang, size, row_number() OVER (PARTITION BY lang ORDER BY source NULLS LAST) - 1 AS idx FROM i),
o AS (SELECT lang, idx, size, row_number() OVER (PARTITION BY lang ORDER BY size, idx) AS n FROM j),
f AS (SELECT lang, idx, size, n, size AS low, n AS began FROM o WHERE n = 1
  UNION ALL SELECT o.lang, o.idx, o.size, o.n, CASE WHEN o.size <= 1.2 * f.low THEN f.low ELSE o.size END, CASE WHEN o.size <= 1.2 * f.low THEN f.began ELSE o.n END FROM f JOIN o ON o.lang = f.lang AND o.n = f.n + 1),
c AS (SELECT *, count(*) OVER (PARTITION BY lang, began) AS members FROM f)
SELECT lang, dense_rank() OVER (PARTITION BY lang ORDER BY began) - 1 AS "group", idx, size AS size_bytes FROM c WHERE members >= 2""")
def compaction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language is a table with a segment per source."""
    sizes = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("size_bytes"))
    infos = sizes.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("source").asc_nulls_last())) - 1)
    return compaction.tier_groups(infos, 1.2, 2, "lang").select("lang", F.col("group").cast("long").alias("group"), "idx", "size_bytes")


@register("SELECT count(*) AS entry_count, sum(strlen(c_name) + strlen(c_mktsegment))::BIGINT AS size_bytes, max(c_custkey) AS lsn FROM customer")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.stats(segment.shaped(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").cast("binary").alias("value"), F.col("c_custkey").alias("lsn"))))


@register("SELECT count(*) AS entries, count(*) FILTER (c_custkey % 97 = 0) AS corrupt FROM customer")
def crc_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry in 97 has its value changed after the checksum."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("key"), F.col("c_mktsegment").cast("binary").alias("value"), F.col("c_custkey").alias("lsn"))
    shaped = segment.shaped(rows).withColumn("value", F.when(F.col("lsn") % 97 == 0, F.concat(F.col("value"), F.lit(b"!"))).otherwise(F.col("value")))
    bad = segment.scrub(shaped).agg(F.count(F.lit(1)).alias("corrupt")).scalar()
    return shaped.agg(F.count(F.lit(1)).alias("entries")).withColumn("corrupt", bad)


@register("SELECT * FROM (VALUES ('', '00000000'), ('a', 'E8B7BE43'), ('abc', '352441C2'), ('message digest', '20159D7F'), ('abcdefghijklmnopqrstuvwxyz', '4C2750BD')) v(data, crc)")
def crc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("",), ("a",), ("abc",), ("message digest",), ("abcdefghijklmnopqrstuvwxyz",)], "data string")
    return df.select("data", F.lpad(F.hex(codec.checksum(F.col("data").cast("binary"))), 8, "0").alias("crc"))


@register(f"WITH {LOG_SQL} SELECT count(*) AS records, count(*) FILTER (lsn % 41 = 0) AS invalid FROM log")
def log_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record in 41 or so has another transaction than its checksum says."""
    log = log_source.with_checksum(event_log(spark, sf_dir)).withColumn("txn_id", F.when(F.col("lsn") % 41 == 0, F.col("txn_id") + 1).otherwise(F.col("txn_id")))
    return log_source.split_valid(log).agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("valid")).alias("invalid"))


_TYPES = " ".join(f"WHEN {n} THEN '{name}'" for n, name in RECORD_TYPES.items())


@register(f"SELECT event_id, CASE event_id % 12 {_TYPES} ELSE 'UNKNOWN' END AS op, event_id % 12 BETWEEN 6 AND 9 AS is_control FROM events")
def record_type_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = codec.record_type(F.col("event_id") % 12)
    return table(spark, sf_dir, "events").select("event_id", op.alias("op")).withColumn("is_control", codec.is_transaction_control(F.col("op")))


@register("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN page_id END AS checkpoint_id FROM pages""")
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint numbers of segment names; two names in four are malformed."""
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/data/sstable_"), n, F.lit("_1700000000.sst"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("sstable_"), n, F.lit(".sst"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("merged_"), n, F.lit(".sst"))).otherwise(F.concat(F.lit("sstable_x"), n, F.lit(".db")))
    return table(spark, sf_dir, "pages").select("page_id", codec.segment_checkpoint_id(path).alias("checkpoint_id"))


@register("SELECT doc_id, text, true AS valid FROM documents UNION ALL SELECT doc_id, NULL, false FROM documents")
def text_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts go to bytes and back; with a byte that no UTF-8 has, they don't."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    data = codec.to_bytes(F.col("t"))
    good, bad = d.select("doc_id", data.alias("data")), d.select("doc_id", F.concat(data, F.lit(b"\xff")).alias("data"))
    return good.unionByName(bad).select("doc_id", codec.from_bytes(F.col("data")).alias("text"), codec.is_text(F.col("data")).alias("valid"))


# -- ordered index: entries, pages


@register("""WITH w AS (SELECT o_custkey AS key, o_orderkey AS lsn, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS value, CASE WHEN o_orderkey % 3 <> 0 THEN 'file' || o_orderkey % 8 || '.sst' END AS file_path, o_orderkey * 100 AS off, o_orderkey % 6 = 1 AS dead FROM orders),
l AS (SELECT key, arg_max({'v': value, 'f': file_path, 'o': off, 'd': dead}, lsn) AS x FROM w GROUP BY key)
SELECT key, x.v AS value, x.f AS file_path, CASE WHEN x.f IS NOT NULL THEN x.o END AS "offset", CASE WHEN x.f IS NOT NULL THEN x.d ELSE x.v IS NULL END AS is_tombstone FROM l""")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ref = F.when(k % 3 != 0, F.struct(F.concat(F.lit("file"), (k % 8).cast("string"), F.lit(".sst")).alias("file_path"), (k * 100).alias("offset"), (k % 6 == 1).alias("is_tombstone")))
    writes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("lsn"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("value"), ref.alias("storage_ref"))
    entries = fold.index_entries(writes)
    return entries.select("key", "value", "storage_ref.file_path", "storage_ref.offset", fold.is_tombstone(F.col("value"), F.col("storage_ref")).alias("is_tombstone"))


@register("SELECT p_brand, p_partkey AS key, (row_number() OVER w - 1) // 16 AS page, (row_number() OVER w - 1) % 16 AS slot FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def page_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand has an index of its parts, in pages of 16."""
    return pages.assign(table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("key")), 16, "key", "p_brand")


_PAGE = 16
_PAGES = f"""r AS (SELECT p_brand, p_partkey AS key, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // {_PAGE} AS page FROM part),
k AS (SELECT p_brand, page, list_sort(list(key)) AS keys FROM r GROUP BY p_brand, page)"""


def _brand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every brand's index of its parts: p_brand, page, entries."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    return pages.collected(pages.assign(rows, _PAGE, "key", "p_brand"), F.struct("key", "value"), "p_brand")


@register(f"WITH {_PAGES} SELECT p_brand, page, len(keys) // 2 AS left_size, keys[len(keys) // 2 + 1] AS median, len(keys) - len(keys) // 2 AS right_size, list_aggregate(keys[:len(keys) // 2], 'max') AS left_last FROM k")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _brand_pages(spark, sf_dir).select("p_brand", "page", pages.split(F.col("entries")).alias("s"))
    return s.select("p_brand", "page", F.size("s.left").cast("long").alias("left_size"), F.col("s.median").alias("median"), F.size("s.right").cast("long").alias("right_size"), F.get(F.col("s.left"), F.size("s.left") - 1)["key"].alias("left_last"))


@register(f"WITH {_PAGES} SELECT p_brand, page, len(list_filter(keys, lambda x: x < 100))::BIGINT AS position FROM k")
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.transform(F.col("entries"), lambda x: x["key"])
    return _brand_pages(spark, sf_dir).select("p_brand", "page", pages.lower_bound(keys, 100).cast("long").alias("position"))


@register("SELECT p_brand, p_partkey AS key, p_name AS value FROM part WHERE p_partkey BETWEEN 50 AND 150")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _brand_pages(spark, sf_dir).select("p_brand", F.explode(pages.in_range(F.col("entries"), KeyRange.closed(50, 150))).alias("x"))
    return rows.select("p_brand", "x.key", "x.value")


@register(f"""WITH {_PAGES}, n AS (SELECT p_brand, page, list_sort(list_distinct(list_append(keys, 100))) AS keys FROM k)
SELECT p_brand, page, list_position(keys, 100)::BIGINT AS position, len(keys) > {_PAGE} AS is_split,
       CASE WHEN len(keys) > {_PAGE} THEN len(keys) // 2 ELSE len(keys) END::BIGINT AS left_size,
       CASE WHEN len(keys) > {_PAGE} THEN keys[len(keys) // 2 + 1] END AS median,
       CASE WHEN len(keys) > {_PAGE} THEN len(keys) - len(keys) // 2 END::BIGINT AS right_size FROM n""")
def page_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key 100 put into every page, those that it overfills being split."""
    entry = F.struct(F.lit(100).cast("long").alias("key"), F.lit("new").alias("value"))
    rows = _brand_pages(spark, sf_dir).select("p_brand", "page", pages.insert(F.col("entries"), entry).alias("whole"), pages.put(F.col("entries"), entry, _PAGE).alias("s"))
    position = F.array_position(F.transform("whole", lambda x: x["key"]), 100).cast("long")
    return rows.select("p_brand", "page", position.alias("position"), F.col("s.median").isNotNull().alias("is_split"), F.size("s.left").cast("long").alias("left_size"), F.col("s.median").alias("median"), F.when(F.col("s.right").isNotNull(), F.size("s.right").cast("long")).alias("right_size"))


# -- the store itself: tables that are written, flushed, compacted and recovered


def _store(spark: SparkSession, **options: object) -> KeyedTable:
    return KeyedTable(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}", **options)


def _pairs(spark: SparkSession, sf_dir: str, where: str, value: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(where).select(F.col("c_name").alias("key"), F.expr(value).cast("binary").alias("value"))


def _written(spark: SparkSession, sf_dir: str, flushes: int) -> KeyedTable:
    """All customers, then every third rewritten, then every tenth deleted, with a flush after each of the first steps."""
    t = _store(spark)
    steps = [
        lambda: t.put(_pairs(spark, sf_dir, "true", "c_mktsegment")),
        lambda: t.put(_pairs(spark, sf_dir, "c_custkey % 3 = 0", "concat('again ', c_custkey)")),
        lambda: t.delete(_pairs(spark, sf_dir, "c_custkey % 10 = 0", "''").select("key")),
    ]
    for i, step in enumerate(steps):
        step()
        if i < flushes:
            t.flush()
    return t


_WRITTEN = "SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'again ' || c_custkey ELSE c_mktsegment END AS value{0} FROM customer WHERE c_custkey % 10 <> 0"


@register(_WRITTEN.format(""))
def store_put_flush_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments and an unflushed tail, read as one state."""
    return text(_written(spark, sf_dir, 2).range())


@register(_WRITTEN.format(", 2::BIGINT AS segments, 0::BIGINT AS unflushed"))
def store_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new process replays the log's tail into a checkpoint of its own; an open transaction stays unseen."""
    t = _written(spark, sf_dir, 1)
    number = t.begin_transaction()
    t.add_to_transaction(number, [("PUT", "open", b"unseen")])
    t = t.recover()
    return text(t.range()).withColumns({"segments": F.lit(len(t.manifest.segments())).cast("long"), "unflushed": F.lit(t.unflushed_bytes()).cast("long")})


@register(_WRITTEN.format(", 1::BIGINT AS segments, (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0) AS entries"))
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments become one, without the deleted keys."""
    t = _written(spark, sf_dir, 3)
    t.compact()
    live = t.manifest.segments()
    return text(t.range()).withColumns({"segments": F.lit(len(live)).cast("long"), "entries": F.lit(live[0]["entry_count"]).cast("long")})


@register(_WRITTEN.format(""))
def store_read_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered index over segments and tail; flushed values are read where the references point."""
    t = _written(spark, sf_dir, 2)
    return text(t.load(t.index()))


@register("SELECT c_name AS key, 'new' AS value FROM customer WHERE c_custkey <= 20")
def store_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CLEAR after a flush, then a flush that replaces the older segment."""
    t = _store(spark)
    t.put(_pairs(spark, sf_dir, "true", "c_mktsegment"))
    t.flush()
    t.clear()
    t.put(_pairs(spark, sf_dir, "c_custkey <= 20", "'new'"))
    t.flush()
    return text(t.range())


@register("SELECT c_name AS key, c_mktsegment AS value FROM customer")
def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at an LSN of the unflushed log, after which all keys were rewritten and some deleted."""
    t = _store(spark)
    at = t.put(_pairs(spark, sf_dir, "true", "c_mktsegment"))
    t.put(_pairs(spark, sf_dir, "true", "'later'"))
    t.delete(_pairs(spark, sf_dir, "c_custkey % 2 = 0", "''").select("key"))
    return text(t.as_of(at).select("key", "value"))


@register("SELECT * FROM (VALUES ('a', '1'), ('c', '3'), ('p', 'q')) v(key, value)")
def store_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One committed transaction, one prepared and committed after a restart, one aborted, one open, and a batch."""
    t = _store(spark)
    one, two, three, four = (t.begin_transaction() for _ in range(4))
    for n, key in ((one, "a"), (two, "p"), (three, "x"), (four, "y")):
        t.add_to_transaction(n, [("PUT", key, b"q" if key == "p" else b"1")])
    t.prepare_transaction(two)
    t.commit_transaction(one)
    t.abort_transaction(three)
    t.execute_batch([("PUT", "b", b"2"), ("PUT", "c", b"3"), ("DEL", "b", None)])
    t = t.recover()
    t.commit_transaction(two)
    return text(t.range())


@register("SELECT * FROM (VALUES (1, 'BEGIN', NULL, 1), (2, 'PUT', 'a', 1), (3, 'COMMIT', NULL, 1), (4, 'BEGIN', NULL, 2), (5, 'CHECKPOINT_START', NULL, 2), (6, 'COMMIT', NULL, 2), (7, 'BEGIN', NULL, 3), (8, 'DEL', 'a', 3), (9, 'COMMIT', NULL, 3), (10, 'BEGIN', NULL, 4), (11, 'PUT', 'b', 4), (12, 'COMMIT', NULL, 4)) v(lsn, op, key, txn_id) WHERE lsn > 5 OR txn_id = 2")
def store_log_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's records after it was cut at a checkpoint's start; single writes and marks are transactions."""
    t = _store(spark)
    t.insert("a", b"1")
    _, lsn = t.begin_checkpoint()
    t.remove("a")
    t.insert("b", b"2")
    t.log.truncate(lsn)
    return t.log.ordered().select("lsn", "op", "key", "txn_id")


_SIZED = "n AS (SELECT greatest(count(*), 1)::DOUBLE AS n FROM customer WHERE c_custkey % 2 = 0), m AS (SELECT n, ceil(-n * ln(0.01) / pow(ln(2), 2))::BIGINT AS m FROM n), z AS (SELECT m, least(greatest(ceil(m / n * ln(2)), 1), 20)::BIGINT AS k FROM m)"
_PLACED = f"SELECT c_custkey, c_name AS key, ({_H.format('a', 'c_name')} + i * ({_H.format('b', 'c_name')} | 1)) % m AS pos, k FROM customer, z, range(20) r(i) WHERE i < k"


@register(f"WITH {_SIZED}, placed AS ({_PLACED}), b AS (SELECT DISTINCT pos FROM placed WHERE c_custkey % 2 = 0) SELECT key, count(b.pos) = any_value(k) AS may_contain FROM placed LEFT JOIN b USING (pos) GROUP BY key")
def store_bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter stored with a segment of every second customer, sized by its entries, asked for all of them."""
    t = _store(spark)
    t.put(_pairs(spark, sf_dir, "c_custkey % 2 = 0", "c_mktsegment"))
    return segment.SegmentReader(spark, t.flush()).may_contain_batch(_everyone(spark, sf_dir))


# -- streams


@register("SELECT user_id::VARCHAR AS key, arg_max(event_type || ':' || event_id, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream, written to a table in micro-batches until there is no more."""
    schema = table(spark, sf_dir, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    # a file source reads a folder: that of the table, or the one where its only file lies
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        source = spark.readStream.schema(schema).parquet(path.toString())
    else:
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    value = F.concat_ws(":", "event_type", F.col("event_id").cast("string")).cast("binary")
    op = F.when(F.col("event_type") == "error", "DEL").otherwise("PUT")
    t = _store(spark)
    rows = source.select(F.col("event_id").alias("order"), op.alias("op"), F.col("user_id").cast("string").alias("key"), value.alias("value"))
    ingest.ingest(rows, t, f"{t.base_path}/progress").awaitTermination()
    return text(t.state().select("key", "value"))
