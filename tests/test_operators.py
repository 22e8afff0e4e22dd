"""Operators on small frames: values that the oracle queries do not reach."""

import datetime
import gzip
import itertools
import json
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, filters, graph, joins, ml, quality, sampling, setops, spatial, stats, windows
from millrace.plans import analytics, catalog, relational
from millrace.sources import blocks, readers, records, sinks
from millrace.streaming import events


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_filters(spark):
    df = frame(spark, "a int, b string, c boolean", (1, "x%y", True), (2, "XY", None), (3, None, False))
    ids = lambda where: sorted(r["a"] for r in df.where(where).collect())
    assert ids(filters.typed({"a": (2, None)})) == [2, 3] and ids(filters.typed({"a": [1, 3], "b": None})) == [1, 3]
    assert ids(filters.contains_text("x%", "b")) == [1] and ids(filters.any_flag("c")) == [1]
    assert ids(filters.parse_search("n>=2 !flag", {"n": "a", "flag": "c"})) == [3]
    assert ids(filters.parse_search("n:1..2 t~x", {"n": "a", "t": "b"})) == [1, 2]
    with pytest.raises(ValueError):
        filters.parse_search("other=1", {"n": "a"})
    with pytest.raises(ValueError):
        filters.sort_key("a; drop", {"a"})


def test_pushdown_and_pruning(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("t")).write.parquet(str(tmp_path / "p"))
    df = readers.load(spark, str(tmp_path / "p"), want=["id", "missing"], where=filters.typed({"k": 3}))
    plan = df._jdf.queryExecution().toString()
    assert df.columns == ["id"] and "EqualTo(k,3)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    assert readers.load(spark, str(tmp_path / "p"), limit=10, key="id").count() == 10
    assert readers.optional(spark, str(tmp_path / "none")) is None
    assert readers.register(spark, {"p": str(tmp_path / "p"), "q": str(tmp_path / "none")}) == {"p": True, "q": False}


def test_not_in_with_nulls(spark):
    left, right = frame(spark, "k int", (1,), (2,), (None,)), frame(spark, "v int", (2,))
    assert [r["k"] for r in joins.not_in(left, "k", right, "v").collect()] == [1]
    assert joins.not_in(left, "k", right.unionAll(frame(spark, "v int", (None,))), "v").count() == 0


def test_lag_by_key_does_not_jump_gaps(spark):
    df = frame(spark, "g int, m int, v double", (1, 1, 1.0), (1, 2, 2.0), (1, 4, 4.0), (1, 5, 5.0))
    assert [(r["m"], r["prev_v"]) for r in joins.lag_by_key(df, ["g"], "m", 2, ["v"]).collect()] == [(4, 2.0)]
    assert {r["m"]: r["prev_v"] for r in joins.previous(df, ["g"], "m", ["v"]).collect()} == {1: None, 2: 1.0, 4: None, 5: 4.0}


def test_table_lookup_outside_is_null(spark):
    df = frame(spark, "a int, b int", (0, 0), (1, 2), (2, 0), (-1, 0), (0, None))
    got = [r[0] for r in df.select(joins.table_lookup([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 6.0, None, None, None]


def test_aggregates_with_nulls(spark):
    df = frame(spark, "k string, v string, x double", ("a", "p", 1.0), ("a", "p", None), ("a", "q", 3.0), ("a", None, 5.0), ("b", None, None))
    assert [(r["k"], r["v"], r["n"]) for r in aggregates.mode_by(df, ["k"], "v").collect()] == [("a", "p", 2)]
    e = {r["k"]: r["entropy"] for r in aggregates.entropy(df, ["k"], "v").collect()}
    assert e == {"a": pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))}
    t = aggregates.between_groups_threshold(df, ["k"], "x", F.col("v") == "p", F.col("v") == "q", 1).collect()
    assert {r["k"]: r["threshold"] for r in t} == {"a": 2.0, "b": None}
    ties = frame(spark, "k int, v int", (1, 5), (1, 4))
    assert aggregates.mode_by(ties, ["k"], "v").first()["v"] == 4


def test_rolling_needs_a_full_window(spark):
    df = frame(spark, "g int, m int, v int", *((1, i, 10 - i) for i in range(1, 10)))
    got = [r[0] for r in df.select("m", windows.rolling_max(F.col("v"), ["g"], ["m"], 8).alias("x")).orderBy("m").select("x").collect()]
    assert got == [None] * 7 + [9, 8]


def test_samples_repeat(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 10)
    a = {r["id"] for r in sampling.uniform(df, "id", 50).collect()}
    assert a == {r["id"] for r in sampling.uniform(df.repartition(7), "id", 50).collect()} and len(a) == 50
    assert a != {r["id"] for r in sampling.uniform(df, "id", 50, seed=1).collect()}
    assert sampling.proportional(df, "g", "id", 95).groupBy("g").count().select("count").distinct().collect()[0][0] == 9


def test_set_operations(spark):
    df = frame(spark, "g int, b int, v int", (1, 2, 10), (1, 1, 20), (1, 1, 30), (2, 2, 40))
    assert sorted(r["v"] for r in setops.first_batch_wins(df, "g", "b").collect()) == [20, 30, 40]
    assert sorted(r["v"] for r in setops.keep_first(df, ["g"], ["b", "v"]).collect()) == [20, 40]


def test_graph_measures(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    pairs = [p for p in pairs if p[0] != p[1]]
    df = frame(spark, "from_node int, to_node int, n long", *((a, b, 1) for a, b in pairs))
    nodes = sorted({x for p in pairs for x in p})
    want = dict.fromkeys(nodes, 0.0)
    out = {a: [b for x, b in pairs if x == a] for a in nodes}
    for s in nodes:
        level, paths, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in out[u]:
                if v not in level:
                    level[v], paths[v] = level[u] + 1, 0.0
                    order.append(v)
                if level[v] == level[u] + 1:
                    paths[v] += paths[u]
        dep = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in out[u]:
                if level.get(v) == level[u] + 1:
                    dep[u] += paths[u] / paths[v] * (1 + dep[v])
            if u != s:
                want[u] += dep[u]
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(df, pivots=100, depth=12).collect()}
    assert {k: got.get(k, 0.0) for k in nodes} == pytest.approx(want)


def test_communities_find_planted_groups(spark):
    groups = [range(0, 8), range(8, 16)]
    edges = [(a, b, 5) for g in groups for a, b in itertools.combinations(g, 2)] + [(0, 8, 1)]
    got = {r["node"]: r["community"] for r in graph.communities(frame(spark, "from_node int, to_node int, n long", *edges)).collect()}
    assert len({got[i] for i in groups[0]}) == 1 == len({got[i] for i in groups[1]}) and got[1] != got[9]
    parts = {r["node"]: r["component"] for r in graph.weak_components(frame(spark, "from_node int, to_node int", (1, 2), (3, 2), (5, 6))).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_long_chains_are_followed_to_their_end(spark):
    n = 70
    chain = frame(spark, "from_node int, to_node int", *((i, i + 1) for i in range(n - 1)))
    assert {r["component"] for r in graph.weak_components(chain).collect()} == {0}
    short = frame(spark, "from_node int, to_node int", *((i, i + 1) for i in range(19)))
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(short).collect()}
    assert got == {i: float(i * (19 - i)) for i in range(1, 20)}
    some = graph.betweenness(short, pivots=10).agg(F.sum("betweenness")).first()[0]
    full = sum(got.values())
    assert 0.4 * full < some < 2 * full


def test_graph_queries_cover_all_edges(spark):
    from millrace.plans import domain

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    pairs = {(r["from_node"], r["to_node"]) for r in domain.walk(spark, d).collect()}
    least = {x: x for p in pairs for x in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert {r["node"]: r["component"] for r in domain.weak_components(spark, d).collect()} == least
    assert {r["node"] for r in domain.communities(spark, d).collect()} == {x for p in pairs if p[0] != p[1] for x in p}


def test_neighbours_and_graph(spark, monkeypatch):
    monkeypatch.setattr(ml, "NEAR_ROWS", 50)
    monkeypatch.setattr(ml, "NEAR_QUERIES", 40)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = ml.neighbours(df, "id", "v", 6)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in near.collect()}
    for i in range(120):
        for k, j in enumerate(np.argsort(d[i])[:6]):
            assert got[i, k + 1][0] == j and got[i, k + 1][1] == pytest.approx(d[i, j])
    weights = [r["weight"] for r in ml.fuzzy_graph(near, "id", 6).collect()]
    assert min(weights) >= 0 and max(weights) <= 1
    one = np.sort(d[0])[:6]
    rho, low, high = one[0], 0.0, 100.0
    for _ in range(100):
        s = (low + high) / 2
        low, high = (low, s) if np.exp(-(one - rho) / s).sum() > np.log2(6) else (s, high)
    back = {r["id"]: r for r in near.where("rank = 6").collect()}
    assert len(back) == 120


def test_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [np.array([[20.0, -20.0]])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in ml.hdbscan(df, "id", "v", least=5).collect()}
    assert set(got) == set(range(121))
    labels = ml.hdbscan_labels(x[:120], 5, 5)
    assert len({*labels[:40]} - {-1}) == 1 and labels[0] != labels[50]
    km = ml.kmeans(ml.vectors(df.where("id < 120"), "v"), "features", 3)
    assert km.select("cluster").distinct().count() == 3 and ml.silhouette(km, "features") > 0.9
    out, shares = ml.pca(ml.vectors(df.where("id < 120"), "v"), "features", 2)
    assert sum(shares) == pytest.approx(1) and len(out.first()["pca"]) == 2
    y = ml.tsne_layout(x[:120], iterations=150)
    assert np.linalg.norm(y[:40].mean(0) - y[40:80].mean(0)) > np.linalg.norm(y[:40] - y[:40].mean(0), axis=1).mean()
    iso = {r["id"]: r["score"] for r in ml.isolation_scores(df.select("id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b")), "id", ["a", "b"]).collect()}
    assert max(iso, key=iso.get) == 120


def test_rows_beyond_the_fitted_ones_are_placed(spark):
    rng = np.random.default_rng(6)
    centers = ((0, 0), (50, 50), (0, 50))
    x = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in centers])
    far = spark.range(1000, 1100).orderBy(F.xxhash64("id").desc()).first()["id"]  # not among the fitted ones
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(far, [900.0, -900.0])], "id long, v array<double>")
    some = df.where("id < 180")
    got = {r["id"]: r["cluster"] for r in ml.hdbscan(df, "id", "v", most=90).collect()}
    assert set(got) == {*range(180), far} and got[far] == -1
    for g in range(3):
        own = [got[i] for i in range(60 * g, 60 * g + 60) if got[i] >= 0]
        assert len(own) > 30 and not set(own) & {got[i] for i in range(180) if i // 60 != g}
    at = {r["id"]: (r["x"], r["y"]) for r in ml.umap(some, "id", "v", k=8, most=90, epochs=50).collect()}
    assert set(at) == set(range(180)) and np.isfinite(list(at.values())).all()
    y = np.array([at[i] for i in range(180)])
    middle = np.array([y[60 * g : 60 * g + 60].mean(0) for g in range(3)])
    nearest = np.linalg.norm(y[:, None] - middle[None], axis=2).argmin(1)
    assert (nearest == np.arange(180) // 60).mean() > 0.9
    with pytest.raises(ValueError):
        ml.tsne(some, "id", "v", most=90)


def test_tree_rules(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), ((F.col("id") % 20) >= 12).cast("int").alias("y"))
    rules = ml.tree_rules(df, ["a"], "y", depth=2, least=5).collect()
    assert sum(r["support"] for r in rules) == 400 and all(r["precision"] == 1.0 for r in rules)


def test_tiles(spark):
    df = frame(spark, "id int, x double, y double, c int", (1, 0.0, 0.0, 1), (2, 1.0, 1.0, 2), (3, 0.5, 0.49, 3), (4, 9.0, -9.0, 4))
    t = spatial.tiled(df, "x", "y", (0.0, 0.0, 1.0, 1.0), (0, 1))
    at = {(r["id"], r["zoom"]): (r["tile_x"], r["tile_y"]) for r in t.collect()}
    assert at[1, 1] == (0, 0) and at[2, 1] == (1, 1) and at[3, 1] == (1, 0) and at[4, 1] == (1, 0) and at[2, 0] == (0, 0)
    p = {(r["zoom"], r["tile_x"], r["tile_y"]): r for r in spatial.tile_payloads(t, "id", "x", "y", ["c"]).collect()}
    whole = json.loads(gzip.decompress(p[0, 0, 0]["payload"]))
    assert [q["id"] for q in whole] == [1, 2, 3, 4] and p[0, 0, 0]["n"] == 4
    same = frame(spark, "id int, x double, y double", (1, 2.0, 3.0))
    assert spatial.tiled(same, "x", "y", (2.0, 3.0, 2.0, 3.0), (2, 2)).select("tile_x").first()[0] == 0


def test_statistics(spark):
    df = frame(spark, "a double, b double", (1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0))
    got = [r["a"] for r in stats.scaled(df, ["a", "b"]).orderBy("a").collect()]
    assert got == pytest.approx([(v - 2.5) / np.std([1, 2, 3, 4]) for v in (1, 2, 3, 4)])
    assert {r["b"] for r in stats.scaled(df, ["a", "b"]).collect()} == {0.0}
    assert stats.ks_two_sample(df.withColumn("f", F.col("a") > 2), "f", "a").first()["ks"] == 1.0


def test_checks(spark):
    df = frame(spark, "k int, m int", (1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 1))
    got = {r["check"]: r["n_bad"] for r in quality.report(quality.gaps(df, "k", "m", "gap"), quality.duplicates(df, ["k", "m"], "twice"), quality.violations(df, {"small": F.col("m") < 3})).collect()}
    assert got == {"gap": 2, "twice": 1, "small": 1}


# --- sources and sinks


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, data in {"d/a.mat": b"one", "d/e/b.mat": b"one", "d/c.txt": b"two", "d/x.bin": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    found = readers.files(spark, str(tmp_path / "d"), ["mat", "txt"])
    m = {r["path"].rsplit("/", 1)[1]: r["copies"] for r in readers.manifest(found).collect()}
    assert m == {"a.mat": 2, "c.txt": 1}
    assert readers.manifest(found, readers.manifest(found).limit(1)).count() == 1
    assert readers.pending(found, found.select("path").limit(2)).count() == 1


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "b", "z": 3}\n{"x": "no", "y": null}\n')
    got = readers.ndjson(spark, str(tmp_path / "a.jsonl"), "x int, y string, w double").collect()
    assert [tuple(r) for r in got] == [(1, "b", None), (None, None, None)]
    (tmp_path / "a.csv").write_text("p,q\n1,x\n")
    assert readers.csv(spark, str(tmp_path / "a.csv")).first().asDict() == {"p": "1", "q": "x"}
    (tmp_path / "d.json").write_text('{\n "total": 3,\n "by": {"a": 1}\n}')
    assert readers.json_document(spark, str(tmp_path / "d.json")).first()["by"]["a"] == 1
    from pyspark.sql import types as T

    df = readers.aligned(frame(spark, "a string, c int", ("7", 1), ("x", 2)), T.StructType().add("a", T.IntegerType()).add("b", T.StringType()))
    assert [tuple(r) for r in df.collect()] == [(7, None), (None, None)]


def test_sinks(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    sinks.hash_partitioned(df, str(tmp_path / "h"), "k", 4, batch="b1")
    sinks.hash_partitioned(df.where("id < 50"), str(tmp_path / "h"), "k", 4, batch="b2")
    sinks.hash_partitioned(df, str(tmp_path / "h"), "k", 4, batch="b1")
    got = spark.read.parquet(str(tmp_path / "h"))
    assert got.count() == 150 and got.groupBy("k").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    told = sinks.materialise(spark, str(tmp_path / "m"), {"a": lambda: df, "b": lambda: df.limit(3)})
    assert told["a"]["rows"] == 100 and json.loads(spark.read.text(str(tmp_path / "m/manifest.json")).first()[0])["tables"]["b"]["rows"] == 3
    for _ in range(2):  # inserting again changes nothing
        sinks.insert_or_ignore(df.unionAll(df), str(tmp_path / "u"), ["id"], ["k"])
    assert spark.read.parquet(str(tmp_path / "u")).count() == 100
    runs = frame(spark, "run_id string, method string, lod int, active boolean", ("a", "m", 0, True), ("b", "m", 0, False), ("c", "m", 1, True))
    assert {r["run_id"]: r["active"] for r in sinks.activated(runs, "b").collect()} == {"a": False, "b": True, "c": True}
    assert {r["run_id"]: r["active"] for r in sinks.activated(runs, "none").collect()} == {"a": True, "b": False, "c": True}
    sinks.csv_report(df, str(tmp_path / "r"), ["id"])
    assert len([f for f in os.listdir(tmp_path / "r") if f.endswith(".csv")]) == 1
    assert sinks.feature_matrix(df, ["id", "k"], str(tmp_path / "f.npy"), "id") == 100
    assert np.load(tmp_path / "f.npy")[13].tolist() == [13.0, 3.0]


def test_blocks(spark):
    move = {"equity": -1234, "win": 5000, "equity_diff": -7, "ply": 3, "steps": [[12, 7], [12, 7], [255, 255], [255, 255]]}
    values = {
        records.CHECKER: [move, {"equity": 5}], records.CUBE: {"win": 9, "double_pass": -3, "best": 2}, records.GAME: {"game_number": 3, "winner": -1, "moves": 300},
        records.ENGINE: {"engine": "é" * 10, "analysis": 4}, records.MATCH: {"player1": "Ann", "length": 7},
    }
    for kind, v in values.items():
        data = blocks.encode(kind, v)
        got = blocks.decode(kind, data)
        for want, g in zip(v if isinstance(v, list) else [v], got if isinstance(got, list) else [got], strict=True):
            assert all(g[k] == x for k, x in want.items())
        with pytest.raises(ValueError):
            blocks.decode(kind, data[:-1])
    assert len(blocks.encode(records.CHECKER, [move])) == 29 and len(blocks.encode(records.CUBE, {})) == 33 and len(blocks.encode(records.GAME, {})) == 11
    df = frame(spark, "s array<int>", ([12, 7, 12, 7, 23, 20, 255, 255],), ([24, 20, 5, 24, 255, 255, 255, 255],), ([255] * 8,))
    assert [r[0] for r in df.select(blocks.move_text(F.col("s"))).collect()] == ["24/21 13/8(2)", "bar/21 6/off", "Cannot Move"]


def test_candidate_moves(spark):
    head = bytearray(records.encode(np.zeros((1, 24), int), {k: np.array([0]) for k in records.SMALL}, np.array([1])))
    head[65] = 1
    payload = blocks.encode(records.CHECKER, [{"equity": 2500, "steps": [[12, 7], [255, 255], [255, 255], [255, 255]]}])
    data = bytes(head) + bytes([records.CHECKER, 1]) + len(payload).to_bytes(2, "little") + payload
    got = blocks.candidate_moves(records.decoded(frame(spark, "path string, content binary", ("a", bytearray(data))))).collect()
    assert [(r["equity"], r["rank"], r["steps"][:2]) for r in got] == [(0.25, 1, [12, 7])]


def test_stream_is_resumed_without_repeats(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    make = lambda low: spark.range(low, low + 20).select((F.col("id") % 15).alias("k"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).alias("ts"), F.lit(1.0).alias("v"))
    make(0).coalesce(1).write.mode("append").parquet(src)
    schema = make(0).schema
    for _ in range(2):
        s = events.first_seen(events.stream(spark, src, schema), "ts", ["k"])
        events.run_once(s, out, ck)
    assert spark.read.parquet(out).count() == 15
    w = events.windowed(make(0), "ts", [], "v", "10 seconds").collect()
    assert sum(r["n"] for r in w) == 20


def test_rank_nulls_last_in_any_partitions(spark, tmp_path):
    rng = random.Random(3)
    values = [rng.randrange(1, 56_000) for _ in range(63)]
    values.append(4 + (2 - sum(values)) % 4)  # hundredths that sum to 2 modulo 4: the mean of 64 is a half at 6 places
    assert sum(values) * 10**4 % 64 == 32
    rows = []
    for user in range(40):
        rng.shuffle(values)
        rows += [(user, v / 100) for v in values]
    rng.shuffle(rows)
    rows = [(i, datetime.datetime(2024, 1, 1), user, v) for i, (user, v) in enumerate(rows)]
    rows += [(3000, None, 40, 1.0), (3001, None, None, None)]
    frame(spark, "event_id long, ts timestamp, user_id long, value double", *rows).repartition(7, F.xxhash64("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    got = relational.rank_nulls_last(spark, str(tmp_path)).collect()
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create table events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet') order by event_id")
    want = con.execute(catalog.ORACLES["rank_nulls_last"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len({r["rating"] for r in got}) == 3


def test_tsne_places_every_row_of_a_large_table(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.5, (1680, 3)) for c in ((0, 0, 0), (30, 30, 0), (0, 30, 30))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, [1.0, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = analytics.tsne_layout(spark, str(tmp_path)).toPandas()
    assert len(got) == 5042 and set(got.vec_id.dropna()) == set(range(5040)) and np.isfinite(got[["x", "y"]].to_numpy()).all()
    y = got.dropna().drop_duplicates("vec_id").sort_values("vec_id")[["x", "y"]].to_numpy()
    some = np.arange(0, 5040, 10)
    apart = np.linalg.norm(y[some, None] - y[None], axis=2)
    apart[np.arange(len(some)), some] = np.inf
    assert (apart.argmin(1) // 1680 == some // 1680).mean() > 0.95


@pytest.mark.parametrize("spread", [0.01, 1.0, 8.0])
def test_tsne_forces(spread):
    rng = np.random.default_rng(9)
    n, k = 700, 12
    y = rng.normal(0, spread, (n, 2))
    q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(q, 0)
    away, total = ml.repulsion(y)
    want = (q * q).sum(1)[:, None] * y - (q * q) @ y
    assert total == pytest.approx(q.sum(), rel=1e-3) and np.linalg.norm(away - want) < 0.01 * np.linalg.norm(want)
    to, p = np.array([rng.choice(n, k, replace=False) for _ in range(n)]), rng.random((n, k))
    both = np.zeros((n, n))
    np.add.at(both, (np.repeat(np.arange(n), k), to.ravel()), p.ravel())
    w = (both + both.T) / 2 * q
    assert ml.attraction(y, to, p) == pytest.approx(w.sum(1)[:, None] * y - w @ y)
