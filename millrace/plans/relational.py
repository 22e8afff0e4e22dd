"""Filters, joins, aggregations, windows, samples and set operations on the test tables, with their oracles.

Roles: lineitem rows stand for positions, orders for games, customers for matches, nations and users for players, events
for moves in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import rate, rate_known, year_of
from ..operators import aggregates, filters, joins, sampling, setops, windows
from .catalog import query, table


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- filters


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05 AND l_linestatus IN ('F', 'O')""")
def typed_filter(spark: SparkSession, d: str) -> DataFrame:
    spec = {"l_returnflag": "R", "l_quantity": (10, 20), "l_discount": (0.05, None), "l_linestatus": ["F", "O"], "l_tax": None}
    return table(spark, d, "lineitem").where(filters.typed(spec)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


@query("""SELECT DISTINCT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 1000
AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)""")
def feature_filter(spark: SparkSession, d: str) -> DataFrame:
    """The conjunctive filter; lines join in, as a semi join, only because a condition on them is set."""
    orders = table(spark, d, "orders").where(filters.typed({"o_orderpriority": "1-URGENT", "o_totalprice": (1000, None), "o_orderstatus": None}))
    lines = table(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.having(orders, lines, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice").distinct()


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size = 7")
def wildcard_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(filters.wildcard({"p_size": 7, "p_partkey": -1})).select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderkey") == 77).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), 'mach')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(filters.contains_text("00012", "c_name") | filters.contains_text("MACH", "c_mktsegment")).select("c_custkey", "c_name", "c_mktsegment")


@query("""SELECT l_partkey, l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'A'
AND contains(lower(l_linestatus), 'f') AND l_discount BETWEEN 0.02 AND 0.06""")
def search_language(spark: SparkSession, d: str) -> DataFrame:
    names = {"qty": "l_quantity", "flag": "l_returnflag", "status": "l_linestatus", "disc": "l_discount"}
    where = filters.parse_search("qty>=45 flag:A status~F disc:0.02..0.06", names)
    return table(spark, d, "lineitem").where(where).select("l_partkey", "l_orderkey", "l_quantity")


@query("""SELECT id, regexp_extract(id, '^(.*)_([^_]*)$', 1) AS head, regexp_extract(id, '^(.*)_([^_]*)$', 2) AS tail
FROM (SELECT 'order_' || o_orderkey || '_' || o_custkey AS id FROM orders)""")
def composite_id(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.concat_ws("_", F.lit("order"), "o_orderkey", "o_custkey").alias("id"))
    head, tail = filters.split_id(F.col("id"))
    return ids.select("id", head.alias("head"), tail.alias("tail"))


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 5000 AND 400000 AND o_orderstatus = 'F'
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20""")
def topk_paginated(spark: SparkSession, d: str) -> DataFrame:
    where = filters.typed({"o_totalprice": (5000, 400000), "o_orderstatus": "F"})
    order = [filters.sort_key("o_totalprice", {"o_totalprice", "o_orderdate"}, descending=True), F.col("o_orderkey")]
    return filters.search(table(spark, d, "orders"), where, order, 20, 50).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 1
AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 60)""")
def flags_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    busy = e.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 60")
    hit = e.where((F.col("event_type") == "click") & (F.col("value") > 1))
    return joins.having(hit, busy, "user_id").select("event_id", "user_id", "value")


# --- joins


@query("""SELECT o_orderkey, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)""")
def semi_join_filter(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.having(table(spark, d, "orders"), big, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n, round(coalesce(avg(l_discount), 0), 6) AS avg_discount
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def left_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Distinct games and mean error per score. Lines are summed per order first, so no distinct count is shuffled."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_discount").alias("s"), F.count("l_discount").alias("c"))
    j = table(spark, d, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderpriority").agg(F.count("o_orderkey").alias("n"), r6(F.coalesce(F.sum("s") / F.sum("c"), F.lit(0.0))).alias("avg_discount"))


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.without(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def not_in_gc(spark: SparkSession, d: str) -> DataFrame:
    return joins.not_in(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_custkey")


@query("""SELECT n_name, c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def three_way_rollup(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation"))  # a fixed list of 25 rows
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("revenue"))


@query("""SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE (o_orderstatus = 'F' AND l_returnflag = 'A') OR (o_orderstatus = 'O' AND l_returnflag = 'R')""")
def side_or_join(spark: SparkSession, d: str) -> DataFrame:
    """One side's condition or the other's; the equi-key keeps it a hash or merge join."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    j = j.where("(o_orderstatus = 'F' and l_returnflag = 'A') or (o_orderstatus = 'O' and l_returnflag = 'R')")
    return j.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


_MOVES = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS move FROM events"


def moves(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("move", F.row_number().over(w))


@query(f"""WITH m AS ({_MOVES}) SELECT a.user_id, a.move, a.event_id, b.event_id AS prev_event_id, b.value AS prev_value
FROM m a JOIN m b ON a.user_id = b.user_id AND b.move = a.move - 2 AND a.event_type = b.event_type""")
def self_join_lag_key(spark: SparkSession, d: str) -> DataFrame:
    out = joins.lag_by_key(moves(spark, d), ["user_id", "event_type"], "move", 2, ["event_id", "value"])
    return out.select("user_id", "move", "event_id", "prev_event_id", "prev_value")


@query(f"""WITH m AS ({_MOVES}) SELECT a.user_id, a.move, a.value, b.value AS prev_value FROM m a LEFT JOIN m b ON a.user_id = b.user_id AND b.move = a.move - 1""")
def prev_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    return joins.previous(moves(spark, d), ["user_id"], "move", ["value"]).select("user_id", "move", "value", "prev_value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber BETWEEN 1 AND 5 AND l_suppkey % 7 BETWEEN 0 AND 4
THEN (l_linenumber - 1) * 10.0 + l_suppkey % 7 END AS looked_up FROM lineitem""")
def composite_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A small table under two keys, as a literal instead of a join."""
    grid = [[r * 10.0 + c for c in range(5)] for r in range(5)]
    got = joins.table_lookup(grid, F.col("l_linenumber") - 1, F.pmod("l_suppkey", F.lit(7)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", got.alias("looked_up"))


@query("""SELECT n_name, side, count(*) AS n, round(avg(v), 6) AS mean FROM (
SELECT c_nationkey AS k, 1 AS side, c_acctbal AS v FROM customer UNION ALL SELECT c_nationkey, 2, c_custkey::DOUBLE FROM customer)
JOIN nation ON n_nationkey = k GROUP BY ALL""")
def unpivot_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("id", F.col("c_custkey").cast("double"))
    sides = joins.unpivot_sides(c, ["c_nationkey"], [["c_acctbal"], ["id"]], ["v"])
    j = sides.join(F.broadcast(table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))
    return j.groupBy("n_name", "side").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 34)")
def bulk_lookup(spark: SparkSession, d: str) -> DataFrame:
    return joins.bulk_lookup(table(spark, d, "part"), "p_partkey", [3, 5, 8, 13, 21, 34, 34]).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(keys, '') AS parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n,
array_to_string(list_sort(list(l_partkey)), ',') AS keys FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    """Games with their moves in one array, instead of a lookup per game."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = joins.with_children(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_quantity"], "l_partkey", "lines")
    return out.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("""SELECT l_orderkey, n_all, n_here FROM (SELECT l_orderkey, l_partkey, count(*) AS n_here FROM lineitem GROUP BY ALL)
JOIN (SELECT l_partkey, count(*) AS n_all FROM lineitem GROUP BY ALL) USING (l_partkey)""")
def occurrence_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    here = lines.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n_here"))
    return here.join(lines.groupBy("l_partkey").agg(F.count("*").alias("n_all")), "l_partkey").select("l_orderkey", "n_all", "n_here")


# --- aggregations


_HEAT = """SELECT l_returnflag, o_orderpriority, count(*) AS n, round(avg(l_discount), 6) AS avg_metric, round(stddev_samp(l_discount), 6) AS std_metric,
round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS filled, round(avg(CASE WHEN l_tax > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS taxed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) >= 20"""


def _heat(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    flags = {"filled": F.col("l_linestatus") == "F", "taxed": F.col("l_tax") > 0.05}
    return aggregates.cells(j, ["l_returnflag", "o_orderpriority"], "l_discount", flags, 20)


@query(_HEAT)
def heat_cells(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: error cells per score with conditional rates."""
    return _heat(spark, d).select("l_returnflag", "o_orderpriority", "n", *(r6(c).alias(c) for c in ("avg_metric", "std_metric", "filled", "taxed")))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS avg_metric FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_returnflag""")
def heat_reagg(spark: SparkSession, d: str) -> DataFrame:
    """Coarser cells from the fine ones, weighted; equals the aggregate from scratch as no cell is below the minimum."""
    fine = aggregates.cells(table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")), ["l_returnflag", "o_orderpriority"], "l_discount", {}, 1)
    return aggregates.regroup(fine, ["l_returnflag"]).withColumn("avg_metric", r6("avg_metric"))


@query("""SELECT label, count(*) AS n, round(avg(embedding[1]), 6) AS cx, round(avg(embedding[2]), 6) AS cy, round(stddev_samp(embedding[1]), 6) AS sx
FROM embeddings WHERE label IS NOT NULL GROUP BY label""")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("label is not null").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return e.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("cx"), r6(F.avg("y")).alias("cy"), r6(F.stddev_samp("x")).alias("sx"))


@query("""SELECT label, n FROM (SELECT count(*) FILTER (l_discount < 0.02) AS a, count(*) FILTER (l_discount >= 0.02 AND l_discount < 0.08) AS b,
count(*) FILTER (l_discount >= 0.08) AS c FROM lineitem) UNPIVOT (n FOR label IN (a AS 'small', b AS 'error', c AS 'blunder'))""")
def fixed_buckets(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_discount")
    return aggregates.labelled_counts(table(spark, d, "lineitem"), {"small": x < 0.02, "error": (x >= 0.02) & (x < 0.08), "blunder": x >= 0.08})


@query("""SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 41 ELSE least(floor(value / 2.5)::INT + 1, 40) END AS bin, count(*) AS n,
round(min(value), 6) AS low, round(max(value), 6) AS high FROM events WHERE value IS NOT NULL GROUP BY 1""")
def width_hist(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.width_histogram(table(spark, d, "events"), "value", 0.0, 100.0, 40)
    return out.select("bin", "n", r6("low").alias("low"), r6("high").alias("high"))


@query("SELECT round(l_discount * 50) / 50 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def round_hist(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.round_histogram(table(spark, d, "lineitem"), "l_discount", 50)


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.percentiles(table(spark, d, "events"), "value", [0.5, 0.75, 0.9, 0.95, 0.99], ["event_type"])
    return out.select("event_type", "n", *(r6(c).alias(c) for c in out.columns[2:]))


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers,
round(count(*) * 1.0::DOUBLE / count(DISTINCT l_partkey), 6) AS convergence FROM lineitem GROUP BY 1""")
def multi_distinct(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    return g.withColumn("convergence", r6(F.col("n") / F.col("n_parts")))


@query("""SELECT k, sum(n) AS volume FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1
UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY k HAVING sum(n) >= 50""")
def union_volume_having(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return a.unionByName(b).groupBy("k").agg(F.sum("n").alias("volume")).where("volume >= 50")


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS games, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS won,
count(l_orderkey) AS moves, round(avg(l_discount), 10) AS avg_error, round(avg(CASE WHEN l_discount > 0.08 THEN 1.0::DOUBLE ELSE 0 END), 10) AS blunders
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 5""")
def career_stats(spark: SparkSession, d: str) -> DataFrame:
    """Games are counted before they fan out into moves, so a won game counts once."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("m"), F.sum("l_discount").alias("s"), F.count("l_discount").alias("c"), F.count_if(F.col("l_discount") > 0.08).alias("b"))
    g = table(spark, d, "orders").join(per, F.expr("l_orderkey = o_orderkey"))
    out = g.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("games"), F.count_if(F.col("o_orderstatus") == "F").alias("won"), F.sum("m").alias("moves"), F.round(F.sum("s") / F.sum("c"), 10).alias("avg_error"), F.round(F.sum("b") / F.sum("m"), 10).alias("blunders"))
    customers = table(spark, d, "customer").select("c_custkey")
    return joins.having(out.where("games >= 5"), customers, "c_custkey")


@query("""SELECT try_cast(substring(o_orderdate::VARCHAR, 1, 4) AS INT) AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean
FROM orders GROUP BY 1 HAVING count(*) >= 10""")
def year_series(spark: SparkSession, d: str) -> DataFrame:
    year = year_of(F.col("o_orderdate").cast("string"))
    return table(spark, d, "orders").groupBy(year.alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).where("n >= 10")


@query("""SELECT user_id, sum(n)::BIGINT AS n, count(*) AS n_values, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy
FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL) GROUP BY 1""")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.entropy(table(spark, d, "events"), ["user_id"], "event_type").withColumn("entropy", r6("entropy"))


@query("""SELECT event_type, round(avg(value) FILTER (user_id % 3 = 0), 6) AS opening, round(avg(value) FILTER (user_id % 3 = 1), 6) AS middle,
round(avg(CASE WHEN value >= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate_all, round(avg((value >= 20)::INT::DOUBLE), 6) AS rate_known FROM events GROUP BY 1""")
def filtered_aggs(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("value"), F.pmod("user_id", F.lit(3))
    aggs = [r6(F.avg(F.when(k == 0, v))).alias("opening"), r6(F.avg(F.when(k == 1, v))).alias("middle"), r6(rate(v >= 20)).alias("rate_all"), r6(rate_known(v >= 20)).alias("rate_known")]
    return table(spark, d, "events").groupBy("event_type").agg(*aggs)


@query(f"""WITH m AS ({_MOVES}) SELECT a.user_id, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM m a JOIN m b
ON a.user_id = b.user_id AND b.move = a.move - 2 GROUP BY 1 HAVING count(*) >= 30""")
def lag_corr(spark: SparkSession, d: str) -> DataFrame:
    pairs = joins.lag_by_key(moves(spark, d), ["user_id"], "move", 2, ["value"])
    return aggregates.lag_correlation(pairs, ["user_id"], "value", "prev_value", 30).withColumn("r", r6("r"))


@query(f"""WITH c AS ({_HEAT}) SELECT l_returnflag, o_orderpriority, n, avg_metric FROM c
WHERE avg_metric >= (SELECT avg(avg_metric) + 0.5 * stddev_samp(avg_metric) FROM c)""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    c = _heat(spark, d).select("l_returnflag", "o_orderpriority", "n", r6("avg_metric").alias("avg_metric"))
    return aggregates.hotspots(c, "avg_metric", 0.5)


@query("""SELECT user_id % 10 AS k, count(value) FILTER (event_type = 'view') AS n_low, count(value) FILTER (event_type = 'purchase') AS n_high,
round(CASE WHEN count(value) FILTER (event_type = 'view') >= 10 AND count(value) FILTER (event_type = 'purchase') >= 10 THEN
(quantile_cont(value, 0.9) FILTER (event_type = 'view') + quantile_cont(value, 0.1) FILTER (event_type = 'purchase')) / 2 END, 6) AS threshold FROM events GROUP BY 1""")
def thresholds_p90_p10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.pmod("user_id", F.lit(10)))
    out = aggregates.between_groups_threshold(e, ["k"], "value", F.col("event_type") == "view", F.col("event_type") == "purchase", 10)
    return out.select("k", "n_low", "n_high", r6("threshold").alias("threshold"))


@query("""SELECT event_type, k, n, round((mean - avg(mean) OVER w) / stddev_samp(mean) OVER w, 5) AS z FROM
(SELECT event_type, user_id % 8 AS k, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type)""")
def zscores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.pmod("user_id", F.lit(8)))
    return aggregates.z_scores(e, ["k"], ["event_type"], "value").select("event_type", "k", "n", F.round("z", 5).alias("z"))


@query("""WITH i AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60), c AS (SELECT event_type, count(*) AS n FROM i GROUP BY 1)
SELECT x.event_type AS a, y.event_type AS b, count(*) AS "both", any_value(p.n + q.n) - count(*) AS either, round(count(*) * 1.0::DOUBLE / (any_value(p.n + q.n) - count(*)), 6) AS jaccard
FROM i x JOIN i y ON x.user_id = y.user_id AND x.event_type < y.event_type JOIN c p ON p.event_type = x.event_type JOIN c q ON q.event_type = y.event_type GROUP BY 1, 2""")
def cooccurrence_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.cooccurrence(table(spark, d, "events").where("value > 60"), "user_id", "event_type").withColumn("jaccard", r6("jaccard"))


@query("""SELECT *, round(n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)""")
def share_of_parent(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.share_of_parent(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"]).withColumn("share", r6("share"))


@query("""SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1""")
def mode_user(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.mode_by(table(spark, d, "events"), ["event_type"], "user_id").select("event_type", "user_id")


@query("""SELECT feature, round(avg(v) FILTER (big), 6) AS mean_in, round(avg(v) FILTER (NOT big), 6) AS mean_out FROM (
SELECT l_quantity >= 40 AS big, unnest(['l_discount', 'l_tax']) AS feature, unnest([l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1""")
def feature_contrast(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.contrast(table(spark, d, "lineitem"), F.col("l_quantity") >= 40, ["l_discount", "l_tax"])
    return out.select("feature", r6("mean_in").alias("mean_in"), r6("mean_out").alias("mean_out"))


@query("""SELECT l_returnflag, count(*) AS n, round(count(*) FILTER (l_linestatus = 'F') * 1.0::DOUBLE / count(*), 6) AS "share_F",
round(count(*) FILTER (l_linestatus = 'O') * 1.0::DOUBLE / count(*), 6) AS "share_O" FROM lineitem GROUP BY 1""")
def crosstab_shares(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.crosstab_shares(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])
    return out.select("l_returnflag", "n", r6("share_F").alias("share_F"), r6("share_O").alias("share_O"))


@query("""SELECT event_type, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max FROM events GROUP BY 1""")
def five_numbers(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.five_numbers(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", *(r6(c).alias(c) for c in ("min", "q1", "median", "q3", "max")))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_totalprice > 300000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate_all,
round(avg(CASE WHEN o_orderstatus = 'F' THEN (o_totalprice > 300000)::INT::DOUBLE END), 6) AS rate_won FROM orders GROUP BY 1""")
def gammon_rates(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.gammon_rates(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000)
    return out.select("o_orderpriority", "n", r6("rate_all").alias("rate_all"), r6("rate_won").alias("rate_won"))


@query("""SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM lineitem) AS n_lines, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_players,
(SELECT round(avg(l_discount), 6) FROM lineitem) AS avg_error""")
def overview(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_players"))
    li = table(spark, d, "lineitem").agg(F.count("*").alias("n_lines"), r6(F.avg("l_discount")).alias("avg_error"))
    return o.join(F.broadcast(li)).select("n_orders", "n_lines", "n_players", "avg_error")  # one row each


@query("""SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, round(quantile_cont(n, 0.5), 6) AS median FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def moves_per_game(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), r6(F.avg("n")).alias("mean"), F.max("n").alias("most"), r6(F.percentile("n", F.lit(0.5))).alias("median"))


# --- windows


@query("""SELECT user_id, from_node, to_node, event_id FROM (SELECT user_id, event_type AS from_node, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_node, event_id FROM events) WHERE to_node IS NOT NULL""")
def lead_edges(spark: SparkSession, d: str) -> DataFrame:
    return windows.transitions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", ["event_id"])


@query("""SELECT event_id, CASE WHEN count(*) OVER w = 8 THEN max(value) OVER w END AS rolling FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def rolling_max8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", windows.rolling_max(F.col("value"), ["user_id"], ["ts", "event_id"], 8).alias("rolling"))


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events")
def lag_prev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", windows.previous_value("event_type", ["user_id"], ["ts", "event_id"]).alias("prev"))


@query("""SELECT user_id, rating, row_number() OVER (ORDER BY rating ASC NULLS LAST, user_id) AS rank FROM
(SELECT user_id, CASE WHEN count(*) >= 60 THEN round(avg(value), 6) END AS rating FROM events GROUP BY 1)""")
def rank_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    means = windows.mean_in_order(table(spark, d, "events"), ["user_id"], ["event_id", "ts"], "value")
    r = means.select("user_id", F.when(F.col("n") >= 60, r6("mean")).alias("rating"))
    return windows.ranked(r, F.col("rating").asc_nulls_last(), "user_id")


@query("""WITH p AS (SELECT user_id, round(avg(value), 6) AS mean, round(max(value), 6) AS peak FROM events GROUP BY 1),
l AS (SELECT user_id, 'mean' AS dimension, mean AS value FROM p UNION ALL SELECT user_id, 'peak', peak FROM p)
SELECT dimension, rank, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, user_id) AS rank FROM l WHERE value IS NOT NULL) WHERE rank <= 10""")
def dim_rank_topn(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("user_id").agg(r6(F.avg("value")).alias("mean"), r6(F.max("value")).alias("peak"))
    return windows.top_by_dimension(p, "user_id", ["mean", "peak"], 10).select("dimension", "rank", "user_id", "value")


@query("""SELECT event_type, tile, count(*) AS n, min(value) AS low, max(value) AS high FROM (SELECT event_type, value, ntile(100) OVER (PARTITION BY event_type ORDER BY value, event_id) AS tile FROM events) GROUP BY ALL""")
def ntile_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return windows.tiles(table(spark, d, "events"), "value", "event_id", 100, ["event_type"])


_LEADS = ", ".join(f"lead(event_type, {i}) OVER w AS n{i}" for i in range(1, 5))


@query(f"""WITH s AS (SELECT event_type AS n0, {_LEADS} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT 3 AS size, n0||'>'||n1||'>'||n2 AS gram FROM s WHERE n2 IS NOT NULL UNION ALL SELECT 4, n0||'>'||n1||'>'||n2||'>'||n3 FROM s WHERE n3 IS NOT NULL
UNION ALL SELECT 5, n0||'>'||n1||'>'||n2||'>'||n3||'>'||n4 FROM s WHERE n4 IS NOT NULL)
SELECT size, gram, n FROM (SELECT size, gram, count(*) AS n, row_number() OVER (PARTITION BY size ORDER BY count(*) DESC, gram) AS r FROM g GROUP BY 1, 2) WHERE r <= 100""")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return windows.ngrams(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", [3, 4, 5], 100)


@query("""SELECT h, from_node, count(*) AS n, count(DISTINCT to_node) AS n_to, round(count(DISTINCT to_node) * 1.0::DOUBLE / count(*), 6) AS divergence FROM (
SELECT 3 AS h, event_type AS from_node, lead(event_type, 3) OVER w AS to_node FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
UNION ALL SELECT 10, event_type, lead(event_type, 10) OVER w FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE to_node IS NOT NULL GROUP BY ALL""")
def divergence_h(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    both = [windows.at_horizon(e, ["user_id"], ["ts", "event_id"], "event_type", h).withColumn("h", F.lit(h)) for h in (3, 10)]
    g = both[0].unionByName(both[1]).groupBy("h", "from_node").agg(F.count("*").alias("n"), F.countDistinct("to_node").alias("n_to"))
    return g.withColumn("divergence", r6(F.col("n_to") / F.col("n")))


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY 1")
def ordered_list(spark: SparkSession, d: str) -> DataFrame:
    out = windows.ordered_lists(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("user_id", F.array_join("sequence", ">").alias("path"))


# --- samples and sets


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 13 = 4")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.systematic(table(spark, d, "orders"), "o_orderkey", 13, 4).select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 20""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.per_group(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 20).select("c_custkey", "c_mktsegment")


@query("""WITH q AS (SELECT c_mktsegment AS g, greatest(1, floor(200 * count(*) / (SELECT count(*) FROM customer))) AS q FROM customer GROUP BY 1)
SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|' || c_custkey), c_custkey) AS r FROM customer) JOIN q ON g = c_mktsegment WHERE r <= q""")
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 200).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_brand FROM part ORDER BY sha256('42|' || p_partkey), p_partkey LIMIT 100")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform(table(spark, d, "part"), "p_partkey", 100).select("p_partkey", "p_brand")


_CELLS = """(SELECT l_returnflag, l_linestatus, l_orderkey * 1000 + l_partkey % 1000 AS id, min(l_discount) AS x, min(l_tax) AS y FROM lineitem GROUP BY 1, 2, 3)"""


@query(f"""WITH r AS (SELECT *, unnest(range(0, 8)) AS draw FROM {_CELLS}),
s AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, draw ORDER BY sha256('42|' || draw || '|' || id), id) AS k FROM r),
m AS (SELECT l_returnflag, l_linestatus, draw, avg(x) AS mx, covar_samp(x, y) AS c FROM s WHERE k <= 50 GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, count(*) AS draws, round(avg(mx), 6) AS mean_x, round(stddev_samp(mx), 6) AS std_x, round(quantile_cont(mx, 0.05), 6) AS p05_x,
round(quantile_cont(mx, 0.95), 6) AS p95_x, round(avg(c), 8) AS covariance FROM m GROUP BY 1, 2""")
def bootstrap_cells(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("id", F.expr("l_orderkey * 1000 + l_partkey % 1000"))
    rows = li.groupBy("l_returnflag", "l_linestatus", "id").agg(F.min("l_discount").alias("x"), F.min("l_tax").alias("y"))
    out = sampling.bootstrap_cells(rows, ["l_returnflag", "l_linestatus"], "id", "x", "y", 8, 50)
    return out.select("l_returnflag", "l_linestatus", "draws", *(r6(c).alias(c) for c in ("mean_x", "std_x", "p05_x", "p95_x")), F.round("covariance", 8).alias("covariance"))


@query("SELECT c_nationkey AS k, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_sides(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side")))


@query("SELECT event_type AS a, NULL::DOUBLE AS b, user_id::DOUBLE AS c FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_type, value, NULL FROM events WHERE event_type NOT IN ('click', 'view')")
def diagonal_concat(spark: SparkSession, d: str) -> DataFrame:
    """Each event on one of the two sides, by its type."""
    e = table(spark, d, "events")
    seen = F.col("event_type").isin("click", "view")
    x = e.where(seen).select(F.col("event_type").alias("a"), F.col("user_id").cast("double").alias("c"))
    return setops.concat(x, e.where(~seen).select(F.col("event_type").alias("a"), F.col("value").alias("b")))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return setops.keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""WITH b AS (SELECT user_id, event_id, (event_id // 100) % 7 AS batch FROM events)
SELECT b.user_id, event_id, batch FROM b JOIN (SELECT user_id, min(batch) AS m FROM b GROUP BY 1) f ON f.user_id = b.user_id AND batch = m""")
def first_batch_wins(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").select("user_id", "event_id", F.expr("(event_id div 100) % 7").alias("batch"))
    return setops.first_batch_wins(b, "user_id", "batch").select("user_id", "event_id", "batch")


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1) GROUP BY 1")
def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes of the new half that the journal of the other half lacks, each with its first document."""
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    new = h.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return setops.new_only(new, h.where("doc_id % 2 = 1"), "h").select("h", "doc_id")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
