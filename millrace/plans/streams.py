"""Windows over event time, and round trips through sources and sinks, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.setops import keep_first
from ..sources import sinks
from ..streaming import events as ev
from .catalog import query, table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    out = ev.windowed(_events(spark, d), "ts", ["event_type"], "value", "6 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT s AS start, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour', time_bucket(INTERVAL '1 hour', ts) - INTERVAL '2 hours']) AS s FROM events) GROUP BY 1""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = ev.windowed(_events(spark, d), "ts", [], "value", "3 hours", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    out = ev.sessions(_events(spark, d), "ts", "user_id", "4 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT user_id, event_type, event_id FROM n WHERE r = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-10')""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """All events: those before a day are there, those from it on come in."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    there = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    return sinks.new_rows(e.where(~there).drop("ts"), e.where(there).drop("ts"), ["user_id", "event_type"], ["event_id"])


@query("""SELECT user_id, event_id FROM (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY 1)
UNION ALL SELECT user_id, max(event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 = 0) GROUP BY 1""")
def insert_or_replace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = e.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return sinks.replaced(old, e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id")), ["user_id"])


@query("""SELECT 'm' || (n_nationkey % 3) || '' AS method, n_nationkey % 2 AS lod, 'r' || n_nationkey AS run_id, CASE WHEN n_nationkey % 3 = 7 % 3 AND n_nationkey % 2 = 1 THEN n_nationkey = 7 ELSE n_nationkey < 6 END AS active FROM nation""")
def activate_run(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    runs = table(spark, d, "nation").select(F.concat(F.lit("m"), (n % 3).cast("string")).alias("method"), (n % 2).alias("lod"), F.concat(F.lit("r"), n.cast("string")).alias("run_id"), (n < 6).alias("active"))
    return sinks.activated(runs, "r7").select("method", "lod", "run_id", "active")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 4)")
def gc_tiles(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "nation").select(F.col("n_nationkey").alias("run_id"), (F.col("n_nationkey") < 4).alias("active"))
    tiles = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("run_id"))
    return sinks.of_active_runs(tiles, runs).select("vec_id", F.col("run_id").alias("label"))


@query("SELECT sha256(text) AS sha256, min(lang || '/' || doc_id) AS path, count(*) AS copies FROM documents GROUP BY 1")
def content_manifest(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import manifest

    docs = table(spark, d, "documents")
    found = docs.select(F.sha2("text", 256).alias("sha256"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.length("text").alias("size"))
    return manifest(found).select("sha256", "path", "copies")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS score1, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS score2,
CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) THEN 1 WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) < sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) THEN 2 ELSE 0 END AS winner FROM orders GROUP BY 1""")
def match_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("score1"), F.count_if(F.col("o_orderstatus") == "O").alias("score2"))
    return g.withColumn("winner", F.when(F.col("score1") > F.col("score2"), 1).when(F.col("score1") < F.col("score2"), 2).otherwise(0))
