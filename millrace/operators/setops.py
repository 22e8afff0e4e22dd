"""Set operations and deduplication with a defined survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the order; unlike dropDuplicates the survivor is fixed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_batch_wins(df: DataFrame, group: str, batch: str) -> DataFrame:
    """All rows of the least batch in which a group occurs. The minimum is an aggregation, so a large group is not sorted."""
    first = df.groupBy(group).agg(F.min(batch).alias("_b"))
    return df.join(first, group).where(F.col(batch) == F.col("_b")).drop("_b")


def new_only(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames over the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
