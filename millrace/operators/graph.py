"""Transition graphs: edges, nodes, paths, attractors, and the iterative measures on bounded subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .aggregates import entropy, mode_by


def aggregated_edges(edges: DataFrame, move: str, error: str) -> DataFrame:
    """(from_node, to_node, n, avg_error, top_move, share): null errors count as 0, share is of all rows leaving from_node."""
    agg = edges.groupBy("from_node", "to_node").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(error), F.lit(0.0))).alias("avg_error"))
    top = mode_by(edges, ["from_node", "to_node"], move).select("from_node", "to_node", F.col(move).alias("top_move"))
    out = agg.join(top, ["from_node", "to_node"], "left")
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_node")))


def nodes(edges: DataFrame, move: str, error: str) -> DataFrame:
    """Per node: visits, in and out degree (distinct neighbours), mean error and entropy of the moves that leave it."""
    out_ = edges.groupBy(F.col("from_node").alias("node")).agg(F.count("*").alias("n_out"), F.countDistinct("to_node").alias("out_degree"), F.avg(error).alias("avg_error"))
    in_ = edges.groupBy(F.col("to_node").alias("node")).agg(F.count("*").alias("n_in"), F.countDistinct("from_node").alias("in_degree"))
    h = entropy(edges.withColumnRenamed("from_node", "node"), ["node"], move).select("node", "entropy")
    both = out_.join(in_, "node", "full").join(h, "node", "left")
    zero = {c: 0 for c in ("n_out", "out_degree", "n_in", "in_degree")}
    return both.fillna(zero)


def attractors(node: DataFrame, top: int = 100) -> DataFrame:
    """Nodes by the ratio of rows that come in to rows that leave."""
    ratio = F.col("n_in") / F.greatest(F.col("n_out"), F.lit(1))
    return node.withColumn("ratio", ratio).orderBy(F.col("ratio").desc(), "node").limit(top)


def crossroads(edges: DataFrame, match: str, top: int = 100) -> DataFrame:
    """Nodes by the number of distinct matches that pass through them."""
    passes = edges.groupBy(F.col("from_node").alias("node")).agg(F.countDistinct(match).alias("n_matches"), F.count("*").alias("n"))
    return passes.orderBy(F.col("n_matches").desc(), "node").limit(top)


def degree_distribution(node: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.lit("in").alias("kind"), F.col("in_degree").alias("degree")), F.struct(F.lit("out").alias("kind"), F.col("out_degree").alias("degree")))
    return node.select(F.inline(sides)).groupBy("kind", "degree").agg(F.count("*").alias("n"))


def subgraph(edges: DataFrame, node: DataFrame, top: int, least: int) -> DataFrame:
    """Aggregated edges of at least `least` rows between the `top` nodes of highest degree."""
    best = node.orderBy((F.col("in_degree") + F.col("out_degree")).desc(), "node").limit(top).select("node")
    out = edges.where(F.col("n") >= least).join(best.withColumnRenamed("node", "from_node"), "from_node", "left_semi")
    return out.join(best.withColumnRenamed("node", "to_node"), "to_node", "left_semi")


def through(sequences: DataFrame, node, column: str = "sequence") -> DataFrame:
    """Sequences that visit a node, with the position of its first visit."""
    return sequences.where(F.array_contains(column, node)).withColumn("at", F.array_position(column, node))


def highways(edges: DataFrame, share: float = 0.5) -> DataFrame:
    """Per node the number of moves and the rows on and off its highways (moves of at least that share)."""
    on = F.col("share") >= share
    return edges.groupBy("from_node").agg(F.count("*").alias("moves"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("highway"), F.sum(F.when(on, 0).otherwise(F.col("n"))).alias("trail"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) by spreading the least label over edges in both directions until nothing changes.

    Rounds follow the diameter, and every round is checkpointed so that plans stay short. A label also moves to the label of
    the node that it names, which halves what is left of a long chain."""
    both = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).union(edges.select("to_node", "from_node")).distinct()
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        met = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("c", "component")).alias("met"), "component")
        named = label.select(F.col("node").alias("met"), F.col("component").alias("next"))
        new = cut(met.join(named, "met", "left").select("node", F.least("met", F.coalesce("next", "met")).alias("new"), "component"))
        label = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").limit(1).count() == 0:
            return label


def betweenness(edges: DataFrame, pivots: int | None = None, depth: int | None = None, seed: int = 42) -> DataFrame:
    """(node, betweenness): shortest-path dependencies from all nodes, unweighted, however long the paths.

    With `pivots`, from that many nodes in the order of a seeded hash, times all nodes by pivots; with `depth`, of paths of
    at most that many steps. Brandes' scheme level by level: path counts go forward, dependencies back. Work grows with
    sources times edges."""
    hop = edges.select(F.col("from_node").alias("u"), F.col("to_node").alias("v")).distinct()
    ends, scale = hop.select("u").union(hop.select("v")).distinct(), 1.0
    if pivots is not None:
        n = ends.count()
        scale = max(1.0, n / pivots)
        ends = ends.orderBy(F.xxhash64("u", F.lit(seed)), "u").limit(pivots)
    seen = ends.select(F.col("u").alias("s"), F.col("u").alias("node"))
    seen = cut(seen.withColumn("level", F.lit(0)).withColumn("paths", F.lit(1.0)))
    front = seen
    level = 0
    while depth is None or level < depth:
        level += 1
        nxt = front.join(hop, front["node"] == hop["u"]).groupBy("s", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        nxt = cut(nxt.join(seen.select("s", "node"), ["s", "node"], "left_anti").withColumn("level", F.lit(level)).select("s", "node", "level", "paths"))
        if nxt.limit(1).count() == 0:
            break
        seen, front = seen.unionByName(nxt), nxt
    seen = cut(seen)
    deepest = seen.agg(F.max("level")).first()[0] or 0
    dep = seen.where(F.col("level") == deepest).select("s", "node", "level", "paths", F.lit(0.0).alias("dep"))
    total = dep
    for level in range(deepest - 1, -1, -1):
        below = dep.select("s", F.col("node").alias("v"), F.col("paths").alias("pv"), F.col("dep").alias("dv"))
        here = seen.where(F.col("level") == level)
        gain = here.join(hop, here["node"] == hop["u"]).join(below, ["s", "v"]).groupBy("s", "node").agg(F.sum(F.col("paths") / F.col("pv") * (1 + F.col("dv"))).alias("gain"))
        dep = cut(here.join(gain, ["s", "node"], "left").select("s", "node", "level", "paths", F.coalesce("gain", F.lit(0.0)).alias("dep")))
        total = total.unionByName(dep)
    return total.where("node <> s").groupBy("node").agg((F.sum("dep") * scale).alias("betweenness"))


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community) by weighted label propagation: every node takes the label with the greatest summed weight among
    its neighbours and itself, ties to the least label; updated in turns by parity so that labels do not swap for ever."""
    w = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("n").cast("double").alias("w"))
    w = w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    label = cut(w.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    for turn in range(2 * rounds):
        votes = w.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("m"), "community"))["community"].alias("new"))
        mine = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        new = cut(label.join(best, F.col("node") == F.col("a"), "left").select("node", F.when(mine, F.coalesce("new", "community")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")))
        stable = turn % 2 and new.where("community <> old").limit(1).count() == 0
        label = new.select("node", "community")
        if stable:
            break
    return label
