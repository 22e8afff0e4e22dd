"""Data checks: each gives one row (check, level, n_bad)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(bad: DataFrame, check: str, level: str) -> DataFrame:
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(check).alias("check"), F.lit(level).alias("level"), "n_bad")


def orphans(child: DataFrame, key: str, parent: DataFrame, other: str, check: str, level: str = "FAIL") -> DataFrame:
    return _row(child.join(parent.select(F.col(other).alias(key)), key, "left_anti"), check, level)


def duplicates(df: DataFrame, keys: Sequence[str], check: str, level: str = "WARN") -> DataFrame:
    """Keys that occur more than once."""
    return _row(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), check, level)


def gaps(df: DataFrame, key: str, position: str, check: str, level: str = "WARN") -> DataFrame:
    """Groups whose positions are not consecutive, each once."""
    g = df.groupBy(key).agg(F.max(position).alias("b"), F.min(position).alias("a"), F.count(position).alias("n"))
    return _row(g.where("b - a + 1 <> n"), check, level)


def violations(df: DataFrame, rules: dict[str, Column], level: str = "FAIL") -> DataFrame:
    """A row per rule with the number of rows that break it (null does not break a rule), in one pass."""
    one = df.agg(*(F.count_if(~c).alias(f"n{i}") for i, c in enumerate(rules.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(level).alias("level"), F.col(f"n{i}").alias("n_bad")) for i, k in enumerate(rules)))))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
