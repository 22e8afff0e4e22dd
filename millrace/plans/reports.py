"""Report queries of the read API and the study scripts on the test tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import bucket, rate
from ..functions.score import recommendation
from ..operators import aggregates, filters, joins, ml, sampling, setops, stats, windows
from .catalog import query, table
from .relational import moves, r6

_GAMES = "(SELECT o_custkey AS player, o_orderkey AS game, o_orderdate AS day, o_totalprice AS points, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS no FROM orders)"


def games(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("points"))
    return o.withColumn("no", F.row_number().over(Window.partitionBy("player").orderBy("day", "game")))


@query("""SELECT c_mktsegment AS tournament, count(DISTINCT c_custkey) AS players, count(*) AS games, round(avg(o_totalprice), 4) AS avg_points, round(avg(CASE WHEN o_totalprice >= 300000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS blunder_rate
FROM customer JOIN orders ON o_custkey = c_custkey WHERE contains(lower(c_mktsegment), 'i') GROUP BY 1 ORDER BY games DESC, tournament LIMIT 20""")
def tournaments(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").where(filters.contains_text("I", "c_mktsegment")).join(table(spark, d, "orders"), F.expr("o_custkey = c_custkey"))
    g = j.groupBy(F.col("c_mktsegment").alias("tournament")).agg(F.countDistinct("c_custkey").alias("players"), F.count("*").alias("games"), F.round(F.avg("o_totalprice"), 4).alias("avg_points"), r6(rate(F.col("o_totalprice") >= 300000)).alias("blunder_rate"))
    return g.orderBy(F.col("games").desc(), "tournament").limit(20)


@query(f"""WITH g AS {_GAMES} SELECT a.player, a.no, round(a.points, 2) AS points, round(b.points, 2) AS before, CASE WHEN b.points IS NULL THEN 'first' WHEN b.points <= 100000 THEN 'after_loss' WHEN b.points <= 250000 THEN 'level' ELSE 'after_win' END AS mood
FROM g a LEFT JOIN g b ON a.player = b.player AND b.no = a.no - 1""")
def tilt(spark: SparkSession, d: str) -> DataFrame:
    """Each game with what the one before brought."""
    out = joins.previous(games(spark, d), ["player"], "no", ["points"])
    mood = F.coalesce(bucket(F.col("prev_points"), [100000, 250000], ["after_loss", "level", "after_win"]), F.lit("first"))
    return out.select("player", "no", F.round("points", 2).alias("points"), F.round("prev_points", 2).alias("before"), mood.alias("mood"))


@query(f"""WITH m AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS move FROM events)
SELECT CASE WHEN move <= 10 THEN '1-10' WHEN move <= 25 THEN '11-25' WHEN move <= 50 THEN '26-50' ELSE '>50' END AS bin, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM m GROUP BY 1""")
def move_bins(spark: SparkSession, d: str) -> DataFrame:
    m = moves(spark, d).withColumn("bin", bucket(F.col("move"), [10, 25, 50], ["1-10", "11-25", "26-50", ">50"]))
    return aggregates.profile(m, ["bin"], "value").select("bin", "n", r6("mean").alias("mean"), r6("median").alias("median"))


_TERCILE = "(SELECT quantile_cont(l_tax, 1 / 3.0::DOUBLE) AS a, quantile_cont(l_tax, 2 / 3.0::DOUBLE) AS b FROM lineitem)"


@query(f"""SELECT CASE WHEN l_tax <= a THEN 'low' WHEN l_tax <= b THEN 'middle' ELSE 'high' END AS tercile, count(l_discount) FILTER (l_linestatus = 'F') AS n_low, count(l_discount) FILTER (l_linestatus = 'O') AS n_high,
round((quantile_cont(l_discount, 0.9) FILTER (l_linestatus = 'F') + quantile_cont(l_discount, 0.1) FILTER (l_linestatus = 'O')) / 2, 6) AS threshold FROM lineitem, {_TERCILE} GROUP BY 1""")
def threshold_terciles(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cuts = li.agg(F.percentile("l_tax", F.lit(1 / 3)).alias("a"), F.percentile("l_tax", F.lit(2 / 3)).alias("b"))  # one row
    t = li.join(F.broadcast(cuts)).withColumn("tercile", F.when(F.col("l_tax") <= F.col("a"), "low").when(F.col("l_tax") <= F.col("b"), "middle").otherwise("high"))
    out = aggregates.between_groups_threshold(t, ["tercile"], "l_discount", F.col("l_linestatus") == "F", F.col("l_linestatus") == "O", 10)
    return out.select("tercile", "n_low", "n_high", r6("threshold").alias("threshold"))


@query("""SELECT user_id, round(value / 100, 6) AS equity, CASE WHEN value / 100 >= 0.5 - CASE WHEN user_id % 10 / 10.0::DOUBLE >= 0.3 THEN user_id % 10 / 10.0::DOUBLE * 0.05 ELSE 0 END THEN 'double' ELSE 'wait' END AS advice, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def cube_recommendations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.col("value") / 100).alias("e"), (F.pmod("user_id", F.lit(10)) / F.lit(10.0)).alias("t"))
    e = e.select("user_id", r6("e").alias("equity"), recommendation(F.col("e"), F.lit(0.5), F.col("t")).alias("advice"))
    return e.groupBy("user_id", "equity", "advice").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5) SELECT p_brand, p_partkey, p_retailprice FROM part WHERE p_brand IN (SELECT p_brand FROM t)""")
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    top = p.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(5)
    return joins.having(p, top, "p_brand").select("p_brand", "p_partkey", "p_retailprice")


@query("""SELECT least(floor((p_retailprice - a) / (b - a) * 50), 49)::INT AS bin, count(*) AS n, round(count(*) * 100.0::DOUBLE / any_value(c), 6) AS percent FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, count(*) AS c FROM part) GROUP BY 1""")
def minmax_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ends = p.agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"), F.count("*").alias("c"))  # one row
    at = F.least(F.floor((F.col("p_retailprice") - F.col("a")) / (F.col("b") - F.col("a")) * 50), F.lit(49)).cast("int")
    return p.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), r6(F.count("*") * 100.0 / F.first("c")).alias("percent"))


@query("""SELECT a, b, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM (SELECT l_linenumber AS a, l_quantity::INT % 7 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 7).alias("b")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("all"))  # one row
    return g.join(F.broadcast(total)).select("a", "b", r6(F.col("n") * 100.0 / F.col("all")).alias("percent"))


@query("""WITH v AS (SELECT l_partkey, count(*) AS visits, avg(l_discount) AS err FROM lineitem GROUP BY 1) SELECT CASE WHEN visits <= 10 THEN 'rare' WHEN visits <= 30 THEN 'known' ELSE 'common' END AS familiarity, count(*) AS nodes, round(avg(err), 6) AS mean FROM v GROUP BY 1""")
def familiarity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("visits"), F.avg("l_discount").alias("err"))
    return v.groupBy(bucket(F.col("visits"), [10, 30], ["rare", "known", "common"]).alias("familiarity")).agg(F.count("*").alias("nodes"), r6(F.avg("err")).alias("mean"))


@query("""WITH v AS (SELECT l_partkey, count(*) AS visits, avg(l_discount) AS err FROM lineitem GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY visits) + (count(*) OVER (PARTITION BY visits) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY round(err, 9)) + (count(*) OVER (PARTITION BY round(err, 9)) - 1) / 2.0::DOUBLE AS rb FROM v)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def familiarity_correlation(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("visits"), F.round(F.avg("l_discount"), 9).alias("err"))
    return stats.spearman(v, "visits", "err").withColumn("rho", r6("rho"))


@query("""SELECT l_returnflag, l_linestatus, id, x FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY sha256('42|' || id), id) AS r FROM
(SELECT l_returnflag, l_linestatus, l_orderkey * 100000 + l_partkey AS id, min(l_discount) AS x FROM lineitem GROUP BY 1, 2, 3)) WHERE r <= 500""")
def cell_scatter(spark: SparkSession, d: str) -> DataFrame:
    """At most 500 points of each score cell."""
    li = table(spark, d, "lineitem").withColumn("id", F.expr("l_orderkey * 100000 + l_partkey"))
    rows = li.groupBy("l_returnflag", "l_linestatus", "id").agg(F.min("l_discount").alias("x"))
    return sampling.per_group(rows, ["l_returnflag", "l_linestatus"], "id", 500)


@query("""SELECT o_orderkey, first_part, n, path FROM (SELECT l_orderkey AS o_orderkey, arg_min(l_partkey, l_partkey) AS first_part, count(*) AS n, string_agg(l_partkey::VARCHAR, '>' ORDER BY l_partkey) AS path FROM lineitem GROUP BY 1) WHERE o_orderkey IN (SELECT o_orderkey FROM orders)""")
def match_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Moves of all games in order, with the first and their number."""
    mine = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    li = joins.having(table(spark, d, "lineitem"), mine, "l_orderkey")
    seq = windows.ordered_lists(li, ["l_orderkey"], ["l_partkey"], "l_partkey", "s")
    return seq.select(F.col("l_orderkey").alias("o_orderkey"), F.col("s")[0].alias("first_part"), F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: x.cast("string")), ">").alias("path"))


@query("""SELECT c_custkey, c_acctbal, n, rating FROM customer JOIN (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS rating FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey IN (1, 2, 4, 5, 7, 8)""")
def compare_players(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("rating"))
    chosen = joins.bulk_lookup(table(spark, d, "customer"), "c_custkey", [1, 2, 4, 5, 7, 8])
    return chosen.join(r, "c_custkey").select("c_custkey", "c_acctbal", "n", "rating")


@query("""SELECT l_shipmode, n FROM (SELECT CASE WHEN l_quantity = floor(l_quantity / 11) * 11 THEN 'double' ELSE 'plain' END || '-' || l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)""")
def dice_by_phase(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_quantity") == F.floor(F.col("l_quantity") / 11) * 11, "double").otherwise("plain")
    return table(spark, d, "lineitem").groupBy(F.concat_ws("-", kind, "l_returnflag").alias("l_shipmode")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, n, peak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n, round(max(value), 6) AS peak FROM events GROUP BY user_id, event_type)) WHERE r <= 2""")
def top_two_per_player(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), r6(F.max("value")).alias("peak"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "event_type")
    return g.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


@query("""SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT min(doc_id) FROM documents GROUP BY source, lang)""")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    return setops.keep_first(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"]).select("doc_id")


@query(None)
def component_counts(spark: SparkSession, d: str) -> DataFrame:
    """Principal components that explain 50, 80 and 90 % of the variance; checked in the tests."""
    got = ml.components_for(ml.vectors(table(spark, d, "embeddings"), "embedding"), "features", [0.5, 0.8, 0.9])
    return spark.createDataFrame(list(got.items()), "share double, components int")


@query("""SELECT l_returnflag, l_linestatus, least(floor(least(greatest(l_discount::DOUBLE, 0), 0.08::DOUBLE) / (0.08::DOUBLE / 16))::INT + 1, 16) AS bin, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1, 2, 3""")
def clipped_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Errors by phase and type in equal bins, clipped at the upper end."""
    return stats.clipped_histogram(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", 0.08, 16)


@query("""WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.95) AS c, quantile_cont(p_retailprice, 0.5) AS m, quantile_cont(p_retailprice, 0.9) AS p FROM part GROUP BY 1)
SELECT p_brand, count(p_retailprice) AS n, round(avg(p_retailprice), 9) AS mean, round(any_value(m), 9) AS median, round(any_value(p), 9) AS p90, round(avg(least(p_retailprice, c)), 9) AS clipped_mean
FROM part JOIN q USING (p_brand) GROUP BY 1""")
def clipped_summary(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty of classes: mean, median, 90th percentile and the mean clipped at the 95th."""
    out = stats.clipped_summary(table(spark, d, "part"), ["p_brand"], "p_retailprice")
    return out.select("p_brand", "n", *(F.round(c, 9).alias(c) for c in ("mean", "median", "p90", "clipped_mean")))


@query("""SELECT place, s_suppkey, s_nationkey, balance FROM (SELECT *, row_number() OVER (ORDER BY balance ASC NULLS LAST, s_nationkey DESC NULLS LAST, s_suppkey) AS place
FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance FROM supplier)) WHERE place <= 50""")
def sorted_by_metric(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty by a chosen metric among those allowed, then by others; nulls last."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))
    keys = [filters.sort_key(k, ("balance", "s_nationkey", "s_suppkey"), down) for k, down in (("balance", False), ("s_nationkey", True), ("s_suppkey", False))]
    page = filters.search(s, F.lit(True), keys, 0, 50)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*keys))).select("place", "s_suppkey", "s_nationkey", "balance")
