"""Sequence operators: transitions, guarded rolling windows, ranks, n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(df: DataFrame, keys: list[str], order: list[str], node: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keys, from_node, to_node, kept columns of the first): consecutive rows; the last row of a sequence has no edge."""
    to = F.lead(node).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(*keys, F.col(node).alias("from_node"), to.alias("to_node"), *keep).where(F.col("to_node").isNotNull())


def at_horizon(df: DataFrame, keys: list[str], order: list[str], node: str, steps: int) -> DataFrame:
    """(from_node, to_node) `steps` apart."""
    to = F.lead(node, steps).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(F.col(node).alias("from_node"), to.alias("to_node")).where(F.col("to_node").isNotNull())


def rolling_max(value: Column, keys: list[str], order: list[str], size: int) -> Column:
    """Maximum of the last `size` rows, null until there are so many."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)
    return F.when(F.count(F.lit(1)).over(w) == size, F.max(value).over(w))


def mean_in_order(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, mean) with doubles added up one after the other in an order of the rows, as a single reader of a sorted table
    does: the last bits, and so what rounding makes of a half, are the same in any partitions. Groups are streamed, not
    gathered; rows equal in order are added by rising value."""
    w = Window.partitionBy(*keys).orderBy(*order, value)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.select(*keys, F.count(F.lit(1)).over(upto).alias("n"), F.avg(value).over(upto).alias("mean"), F.lead(F.lit(1)).over(w).alias("_more"))
    return rows.where("_more is null").drop("_more")


def previous_value(value: str, keys: list[str], order: list[str], steps: int = 1) -> Column:
    return F.lag(value, steps).over(Window.partitionBy(*keys).orderBy(*order))


def ranked(df: DataFrame, by: Column, tie: str, name: str = "rank") -> DataFrame:
    """Global positions 1.. in an order with a unique tie-breaker, a null one last. Meant for report tables; one task orders all rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(by, F.col(tie).asc_nulls_last())))


def top_by_dimension(df: DataFrame, key: str, dimensions: Sequence[str], n: int, descending: bool = True) -> DataFrame:
    """(dimension, rank, key, value) of the n best keys in each column, nulls never among them."""
    long = df.unpivot([key], list(dimensions), "dimension", "value").where(F.col("value").isNotNull())
    best = F.col("value").desc() if descending else F.col("value").asc()
    w = Window.partitionBy("dimension").orderBy(best, F.col(key))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tiles(df: DataFrame, value: str, tie: str, n: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """ntile(n) sketch: least and greatest value and rows of each tile."""
    t = df.withColumn("tile", F.ntile(n).over(Window.partitionBy(*keys).orderBy(value, tie)))
    return t.groupBy(*keys, "tile").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def ngrams(df: DataFrame, keys: list[str], order: list[str], node: str, sizes: Sequence[int], top: int) -> DataFrame:
    """(size, gram, n) of the `top` most frequent runs of each size, ties by the gram's text. One window for all sizes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = [F.col(node).cast("string"), *(F.lead(F.col(node).cast("string"), i).over(w) for i in range(1, max(sizes)))]
    rows = df.select(*(c.alias(f"n{i}") for i, c in enumerate(ahead)))
    grams = F.array(*(F.when(F.col(f"n{k - 1}").isNotNull(), F.struct(F.lit(k).alias("size"), F.concat_ws(">", *(F.col(f"n{i}") for i in range(k))).alias("gram"))) for k in sizes))
    counts = rows.select(F.inline(F.filter(grams, lambda g: g.isNotNull()))).groupBy("size", "gram").agg(F.count("*").alias("n"))
    best = Window.partitionBy("size").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank")


def ordered_lists(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "sequence") -> DataFrame:
    """Each key's values as an array in order."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, *([value] if value not in order else []))))
    return df.groupBy(*keys).agg(F.transform(sorted_, lambda s: s[value]).alias(name))
