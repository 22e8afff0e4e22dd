"""Joins beyond the plain ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast on the caller's word.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted up to one more), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def having(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left with a partner: a semi join, which needs no DISTINCT afterwards."""
    return left.join(right, on, "left_semi")


def without(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left without a partner; rows with a null key have none."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """SQL's NOT IN: rows with a null key drop out, and a null on the right leaves no row at all."""
    has_null = right.select(F.col(other).alias("k")).where("k is null").limit(1)
    kept = left.where(F.col(column).isNotNull()).join(right.select(F.col(other).alias(column)), column, "left_anti")
    nulls = has_null.select(F.lit(True).alias("stop"))
    return kept.withColumn("_k", F.lit(True)).join(F.broadcast(nulls), F.col("_k") == F.col("stop"), "left_anti").drop("_k")


def with_children(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str], order: str, name: str = "children") -> DataFrame:
    """Parents with their children as an ordered array of structs, empty where there are none. One shuffle, no lookup per row."""
    first = [order, *(c for c in columns if c != order)]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def lag_by_key(df: DataFrame, keys: list[str], position: str, distance: int, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Inner join of each row with that of the same keys whose position is `distance` less. Unlike a window's lag it does
    not take a neighbour across a gap."""
    before = df.select(*keys, (F.col(position) + distance).alias(position), *(F.col(c).alias(prefix + c) for c in columns))
    return df.join(before, [*keys, position])


def previous(df: DataFrame, keys: list[str], position: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Left join with the row of position - 1."""
    before = df.select(*keys, (F.col(position) + 1).alias(position), *(F.col(c).alias(prefix + c) for c in columns))
    return df.join(before, [*keys, position], "left")


def table_lookup(table: Sequence[Sequence[float]], row: Column, column: Column, base: int = 0) -> Column:
    """table[row - base][column - base] from a literal, null outside it: no join for a small composite key."""
    flat = F.from_json(F.lit(str([float(x) for r in table for x in r])), "array<double>")
    width, height = len(table[0]), len(table)
    r, c = (row - base).cast("int"), (column - base).cast("int")
    inside = r.between(0, height - 1) & c.between(0, width - 1)
    return F.when(inside, F.get(flat, r * width + c))


def unpivot_sides(df: DataFrame, keys: list[str], sides: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """One row per side: keys, `side` (from 1) and the side's columns under common names. One scan instead of a union."""
    rows = F.array(*(F.struct(F.lit(i + 1).alias("side"), *(F.col(c).alias(n) for c, n in zip(side, names, strict=True))) for i, side in enumerate(sides)))
    return df.select(*keys, F.inline(rows))


def bulk_lookup(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is among the given values, which become a small joined table."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return df.join(F.broadcast(wanted.distinct()), column, "left_semi")
