"""Statistics, tiles, models and data checks on the test tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml, quality, spatial, stats
from .catalog import query, table
from .relational import r6

# --- statistics


@query("""SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size,
round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part""")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    out = stats.scaled(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", r6("p_size").alias("p_size"), r6("p_retailprice").alias("p_retailprice"))


@query("""SELECT p_partkey, round((p_retailprice - a) / (b - a), 6) AS p_retailprice FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)""")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    out = stats.scaled(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "minmax")
    return out.select("p_partkey", r6("p_retailprice").alias("p_retailprice"))


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", r6("r"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0::DOUBLE AS rb FROM lineitem)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount").withColumn("rho", r6("rho"))


@query("""WITH j AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS na, sum(n) OVER (PARTITION BY l_linenumber) AS nb FROM j)
SELECT sum(n)::BIGINT AS n, round(log2(sum(n)) + sum(n * log2(n::DOUBLE / (na::DOUBLE * nb))) / sum(n), 8) AS mi FROM k""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return stats.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber").withColumn("mi", F.round("mi", 8))


@query("""WITH u AS (SELECT user_id, avg(value) AS y, count(*)::DOUBLE AS x FROM events GROUP BY 1), l AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS b FROM u)
SELECT user_id, round(b + k * x, 6) AS expected, round(y - (b + k * x), 6) AS residual FROM u, l""")
def ols_residuals(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("x"))
    return stats.residuals(u, "user_id", "y", "x").select("user_id", r6("expected").alias("expected"), r6("residual").alias("residual"))


@query("""WITH c AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type <> 'click') AS b FROM events GROUP BY 1),
s AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW w AS (ORDER BY value))
SELECT max(na)::BIGINT AS na, max(nb)::BIGINT AS nb, round(max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)), 6) AS ks FROM s""")
def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("f", F.col("event_type") == "click")
    return stats.ks_two_sample(e, "f", "value").withColumn("ks", r6("ks"))


@query("""SELECT user_id, n, round(m, 6) AS mean, round(CASE WHEN n >= 60 THEN m - 1.96 * s / sqrt(n) ELSE m * 0.7 END, 6) AS low, round(CASE WHEN n >= 60 THEN m + 1.96 * s / sqrt(n) ELSE m * 1.3 END, 6) AS high
FROM (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)""")
def confidence_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = stats.confidence(table(spark, d, "events"), ["user_id"], "value", 60)
    return out.select("user_id", "n", *(r6(c).alias(c) for c in ("mean", "low", "high")))


# --- arrays and text


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(list_min(embedding)::DOUBLE, 6) AS least FROM embeddings")
def array_sum_min(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_min(e), 6).alias("least"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_prop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT game, count(*) AS n FROM (SELECT regexp_replace('m' || o_custkey || '_game_' || o_orderkey, '_game_\\d+$', '') AS game FROM orders) GROUP BY 1")
def regex_strip(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat(F.lit("m"), F.col("o_custkey").cast("string"), F.lit("_game_"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").groupBy(F.regexp_replace(ids, r"_game_\d+$", "").alias("game")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS n, len(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) AS words FROM documents")
def slice_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.size(F.filter(F.split(t, r"[ \n\t\r]+"), lambda x: x != "")).cast("long").alias("words"))


# --- tiles


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


_POINTS = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"
_BOX = f"(SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {_POINTS})"
_TILE = "least(floor(least(greatest(({0} - {0}0) / ({0}1 - {0}0), 0), 1) * (1 << zoom))::INT, (1 << zoom) - 1)"


@query(f"""SELECT zoom, tile_x, tile_y, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, zoom, {_TILE.format("x")} AS tile_x, {_TILE.format("y")} AS tile_y
FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS zoom FROM {_POINTS}, {_BOX})) GROUP BY ALL""")
def tile_bins(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    t = spatial.tiled(p, "x", "y", spatial.bounds(p, "x", "y"), (0, 5))
    return t.groupBy("zoom", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query(None)
def tile_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped tiles; the tests unpack them and compare with the points."""
    p = points(spark, d)
    return spatial.tile_payloads(spatial.tiled(p, "x", "y", spatial.bounds(p, "x", "y"), spatial.ZOOMS[1]), "vec_id", "x", "y", ["label"])


@query(f"SELECT 0 AS min_zoom, 2 AS max_zoom, count(*) AS n_tiles, sum(n)::BIGINT AS n_points FROM (SELECT zoom, tile_x, tile_y, count(*) AS n FROM (SELECT zoom, {_TILE.format('x')} AS tile_x, {_TILE.format('y')} AS tile_y FROM (SELECT *, unnest([0, 1, 2]) AS zoom FROM {_POINTS}, {_BOX})) GROUP BY ALL)")
def tile_meta(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    t = spatial.tiled(p, "x", "y", spatial.bounds(p, "x", "y"), spatial.ZOOMS[0]).groupBy("zoom", "tile_x", "tile_y").agg(F.count("*").alias("n"))
    return spatial.tile_meta(t)


@query(f"""WITH g AS (SELECT round(x / 0.05) * 0.05 AS gx, round(y / 0.05) * 0.05 AS gy, label, vec_id FROM {_POINTS}), c AS (SELECT gx, gy, label, count(*) AS n FROM g GROUP BY ALL)
SELECT round(gx, 6) AS gx, round(gy, 6) AS gy, n, round(mean, 6) AS mean, top FROM (SELECT gx, gy, count(*) AS n, avg(vec_id) AS mean FROM g GROUP BY ALL)
JOIN (SELECT gx, gy, label AS top FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY n DESC, label) AS r FROM c) WHERE r = 1) USING (gx, gy)""")
def grid_bins(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.grid(points(spark, d), "x", "y", 0.05, "vec_id", "label")
    return out.select(r6("gx").alias("gx"), r6("gy").alias("gy"), "n", r6("mean").alias("mean"), "top")


@query(f"SELECT vec_id, label FROM {_POINTS} WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0 AND 0.2 ORDER BY vec_id LIMIT 5000")
def viewport(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.filters import search
    from ..operators.filters import viewport as within

    return search(points(spark, d), within(F.col("x"), F.col("y"), (-0.1, 0.0, 0.1, 0.2)), [F.col("vec_id")], 0, 5000).select("vec_id", "label")


@query(f"""SELECT px, py, count(*) AS n, round(ln(1 + count(*)), 6) AS level FROM (SELECT least(floor((x - x0) / (x1 - x0) * 256)::INT, 255) AS px, least(floor((y - y0) / (y1 - y0) * 256)::INT, 255) AS py FROM {_POINTS}, {_BOX}) GROUP BY 1, 2""")
def density_raster(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    out = spatial.raster(p, "x", "y", spatial.bounds(p, "x", "y"), 256)
    return out.select("px", "py", "n", r6("level").alias("level"))


@query(f"""WITH g AS (SELECT i AS gx, j AS gy, -0.5::DOUBLE + i / 20.0::DOUBLE AS cx, -0.5::DOUBLE + j / 20.0::DOUBLE AS cy FROM range(0, 21) a(i), range(0, 21) b(j))
SELECT gx, gy, round(sum(exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 0.0025::DOUBLE))) / ((SELECT count(*) FROM {_POINTS}) * 2 * pi() * 0.0025::DOUBLE), 3) AS density
FROM g, {_POINTS} WHERE abs(x - cx) <= 0.2::DOUBLE + 1e-12 AND abs(y - cy) <= 0.2::DOUBLE + 1e-12 GROUP BY 1, 2""")
def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.density(points(spark, d), "x", "y", (-0.5, -0.5, 0.5, 0.5), 21, 0.05)
    return out.select("gx", "gy", F.round("density", 3).alias("density"))


# --- models


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT a.vec_id, b.vec_id AS neighbour, array_distance(a.v, b.embedding::DOUBLE[64]) AS distance FROM q a, embeddings b WHERE a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM p) WHERE rank <= 10""")
def knn_bruteforce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    out = ml.neighbours(e, "vec_id", "embedding", 10, e.where("vec_id % 20 = 0"))
    return out.select("vec_id", "neighbour", r6("distance").alias("distance"), "rank")


@query(None)
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    out, _ = ml.pca(ml.vectors(table(spark, d, "embeddings"), "embedding"), "features", 2, standardise=True)
    return out.select("vec_id", F.round(F.col("pca")[0], 6).alias("x"), F.round(F.col("pca")[1], 6).alias("y"))


@query(None)
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    out = ml.kmeans(ml.vectors(table(spark, d, "embeddings"), "embedding"), "features", 8)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


@query(None)
def fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    near = ml.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 15)
    return ml.fuzzy_graph(near, "vec_id", 15)


@query(None)
def umap_layout(spark: SparkSession, d: str) -> DataFrame:
    return ml.umap(table(spark, d, "embeddings"), "vec_id", "embedding", epochs=100)


@query(None)
def tsne_layout(spark: SparkSession, d: str) -> DataFrame:
    return ml.tsne(table(spark, d, "embeddings"), "vec_id", "embedding", iterations=100)


@query(None)
def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    return ml.hdbscan(table(spark, d, "embeddings"), "vec_id", "embedding", least=5).groupBy("cluster").agg(F.count("*").alias("n"))


@query(None)
def tree_rules(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("late", (F.col("l_quantity") * F.col("l_discount") > 1.5).cast("int"))
    return ml.tree_rules(li, ["l_quantity", "l_discount", "l_tax"], "late")


@query(None)
def tree_importances(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("y", F.col("l_quantity") * F.col("l_discount"))
    got = ml.importances(li, ["l_quantity", "l_discount", "l_tax"], "y", 8, 5)
    return spark.createDataFrame(list(got.items()), "feature string, importance double")


@query(None)
def outliers(spark: SparkSession, d: str) -> DataFrame:
    out = ml.isolation_scores(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return out.orderBy(F.col("score").desc(), "p_partkey").limit(50)


# --- data checks


@query("SELECT 'line_without_order' AS \"check\", 'FAIL' AS level, count(*) AS n_bad FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def dq_orphans(spark: SparkSession, d: str) -> DataFrame:
    return quality.orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey", "line_without_order")


@query("SELECT 'line_twice' AS \"check\", 'WARN' AS level, count(*) AS n_bad FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dq_dups(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "line_twice")


@query("SELECT 'line_gap' AS \"check\", 'WARN' AS level, count(*) AS n_bad FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) - min(l_linenumber) + 1 <> count(*))")
def dq_gaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.gaps(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "line_gap")


@query("""SELECT 'discount' AS "check", 'FAIL' AS level, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) AS n_bad FROM lineitem UNION ALL SELECT 'quantity', 'FAIL', count(*) FILTER (NOT l_quantity > 0) FROM lineitem""")
def dq_ranges(spark: SparkSession, d: str) -> DataFrame:
    return quality.violations(table(spark, d, "lineitem"), {"discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") > 0})
