"""Connected components of an edge table, by hooking to smaller neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_empty, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Every node first points at its smallest neighbour or itself, which makes a forest as pointers only go down. Pointer
    jumping flattens it in about log(depth) joins, edges are rewritten to their ends' roots, and the rest repeats on the
    contracted graph. All steps are joins and aggregations with map-side combining: no node's neighbours are gathered in
    one place, and only convergence flags reach the driver. Self-loops and edges with a null end are dropped."""
    live = materialize(
        edges.where(f"{a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges"
    )
    root_of = None
    while not is_empty(live):
        ends = live.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(live.select("b", "a"))
        parent = materialize(ends.groupBy("n").agg(F.min("m").alias("p")).select("n", F.least("n", "p").alias("p")), "parents")
        while True:
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("q"))
            jumped = materialize(parent.join(up, "p").select("n", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "parents")
            discard(parent)
            parent = jumped
            if is_empty(parent.where("moved")):
                break
        step = parent.select("n", "p")
        if root_of is None:
            root_of = step
        else:
            moved = step.select(F.col("n").alias("p"), F.col("p").alias("q"))
            root_of = materialize(root_of.join(moved, "p", "left").select("n", F.coalesce("q", "p").alias("p")), "roots")
        of_a, of_b = step.select(F.col("n").alias("a"), F.col("p").alias("ra")), step.select(F.col("n").alias("b"), F.col("p").alias("rb"))
        rest = live.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        rest = materialize(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(live)
        live = rest
    if root_of is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return root_of.select(F.col("n").alias("node"), F.col("p").alias("component"))
