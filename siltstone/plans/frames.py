"""The engine's objects made from the given tables: a mutation log, keyed tables and segments.

``LOG_SQL`` is the DuckDB form of ``event_log``; both follow one rule:
an event is a record at LSN 4 * event_id + 4 of the key user_id, a DEL for the
type ``error`` and a PUT otherwise. Two events in three belong to transaction
1 + event_id // 50. A transaction whose number divides by 5 aborts, one that
leaves 3 by 7 stays open, the others commit. One CLEAR stands by itself at a
fifth of the log and one in an aborted transaction at three fifths; every
thousandth event or so has a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    null = F.lit(None)

    def record(lsn: Column, op: Column, key: Column = null, value: Column = null, id_: Column = null, txn: Column = F.lit(0)) -> list[Column]:
        return [lsn.cast("long").alias("lsn"), op.alias("op"), key.cast("string").alias("key"), value.cast("binary").alias("value"), id_.cast("long").alias("id"), txn.cast("long").alias("txn_id")]

    lsn = 4 * F.col("event_id") + 4
    number = 1 + F.floor(F.col("event_id") / 50)
    data = e.select(*record(lsn, F.when(F.col("event_type") == "error", "DEL").otherwise("PUT"), F.col("user_id"), F.when(F.col("event_type") != "error", F.concat_ws(":", "event_type", F.col("event_id").cast("string"))), txn=F.when(F.col("event_id") % 3 == 0, 0).otherwise(number)))
    t = e.filter("event_id % 3 <> 0").groupBy(number.alias("t")).agg(F.min(lsn).alias("a"), F.max(lsn).alias("b"))
    unfinished = F.col("t") % 7 == 3
    steps = F.filter(
        F.array(
            F.struct((F.col("a") - 1).alias("lsn"), F.lit("BEGIN").alias("op"), F.lit(True).alias("yes")),
            F.struct((F.col("b") + 1).alias("lsn"), F.lit("PREPARE").alias("op"), (unfinished | (F.col("t") % 2 == 1)).alias("yes")),
            F.struct((F.col("b") + 2).alias("lsn"), F.when(F.col("t") % 5 == 0, "ABORT").otherwise("COMMIT").alias("op"), (~unfinished).alias("yes")),
        ),
        lambda x: x["yes"],
    )
    control = t.select("t", F.explode(steps).alias("x")).select(*record(F.col("x.lsn"), F.col("x.op"), txn=F.col("t")))
    marks = e.filter("event_id % 1000 = 10").select(F.explode(F.array(F.struct((lsn + 1).alias("lsn"), F.lit("CHECKPOINT_START").alias("op")), F.struct((lsn + 2).alias("lsn"), F.lit("CHECKPOINT_END").alias("op")))).alias("x"), (F.floor(F.col("event_id") / 1000) + 1).alias("n"))
    checkpoints = marks.select(*record(F.col("x.lsn"), F.col("x.op"), id_=F.col("n")))
    last = e.agg(F.max("event_id").alias("m"))
    one, two = 50 * F.floor(F.col("m") / 250) + 25, 50 * (5 * F.floor(F.col("m") * 0.6 / 250) + 4) + 25
    clears = last.select(F.explode(F.array(F.struct(one.alias("e"), F.lit(0).cast("long").alias("t")), F.struct(two.alias("e"), (1 + F.floor(two / 50)).alias("t")))).alias("x")).select(*record(4 * F.col("x.e") + 5, F.lit("CLEAR"), txn=F.col("x.t")))
    return data.unionByName(control).unionByName(checkpoints).unionByName(clears)


LOG_SQL = """
e AS (SELECT event_id, user_id, event_type, 4 * event_id + 4 AS l FROM events),
t AS (SELECT 1 + event_id // 50 AS t, min(l) AS a, max(l) AS b FROM e WHERE event_id % 3 <> 0 GROUP BY 1),
m AS (SELECT max(event_id) AS m FROM e),
log AS (
  SELECT l AS lsn, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op, user_id::VARCHAR AS key,
         CASE WHEN event_type <> 'error' THEN event_type || ':' || event_id END AS value, NULL::BIGINT AS id,
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id // 50 END AS txn_id FROM e
  UNION ALL SELECT a - 1, 'BEGIN', NULL, NULL, NULL, t FROM t
  UNION ALL SELECT b + 1, 'PREPARE', NULL, NULL, NULL, t FROM t WHERE t % 7 = 3 OR t % 2 = 1
  UNION ALL SELECT b + 2, CASE WHEN t % 5 = 0 THEN 'ABORT' ELSE 'COMMIT' END, NULL, NULL, NULL, t FROM t WHERE t % 7 <> 3
  UNION ALL SELECT l + 1, 'CHECKPOINT_START', NULL, NULL, event_id // 1000 + 1, 0 FROM e WHERE event_id % 1000 = 10
  UNION ALL SELECT l + 2, 'CHECKPOINT_END', NULL, NULL, event_id // 1000 + 1, 0 FROM e WHERE event_id % 1000 = 10
  UNION ALL SELECT 4 * (50 * (m // 250) + 25) + 5, 'CLEAR', NULL, NULL, NULL, 0 FROM m
  UNION ALL SELECT 4 * (50 * (5 * floor(m * 0.6 / 250)::BIGINT + 4) + 25) + 5, 'CLEAR', NULL, NULL, NULL, 1 + (50 * (5 * floor(m * 0.6 / 250)::BIGINT + 4) + 25) // 50 FROM m
),
done AS (SELECT txn_id FROM log WHERE txn_id <> 0 AND op IN ('COMMIT', 'ABORT') GROUP BY txn_id HAVING arg_max(op, lsn) = 'COMMIT'),
com AS (SELECT * FROM log WHERE txn_id = 0 OR txn_id IN (SELECT txn_id FROM done))
"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed table: name to market segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").cast("binary").alias("value"))


def order_segments(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three overlapping segments of orders: all, every third key rewritten, every fifth key deleted or rewritten."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key")

    def version(rows: DataFrame, n: int, dead: Column) -> DataFrame:
        value = F.when(~dead, F.concat(F.col("o_orderpriority"), F.lit(f"#{n}"))).cast("binary")
        return rows.select(key, value.alias("value"), dead.alias("tombstone"))

    return [version(o, 0, F.lit(False)), version(o.filter("o_orderkey % 3 = 0"), 1, F.lit(False)), version(o.filter("o_orderkey % 5 = 0"), 2, F.col("o_orderkey") % 2 == 0)]


SEGMENTS_SQL = """
seg AS (
  SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS key, o_orderpriority || '#0' AS value, false AS tombstone, 0 AS seq FROM orders
  UNION ALL SELECT lpad(o_orderkey::VARCHAR, 12, '0'), o_orderpriority || '#1', false, 1 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT lpad(o_orderkey::VARCHAR, 12, '0'), CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority || '#2' END, o_orderkey % 2 = 0, 2 FROM orders WHERE o_orderkey % 5 = 0
)
"""
