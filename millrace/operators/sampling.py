"""Samples that reruns and other engines repeat: rows are ordered by a seeded SHA-256 of their id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_order


def uniform(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all): the first in hash order."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def per_group(df: DataFrame, groups: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of every group."""
    w = Window.partitionBy(*groups).orderBy(seeded_order(seed, F.col(key)), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def proportional(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows, of each group floor(n * its share), at least one."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy())
    quota = sizes.select(F.col(group).alias("_g"), F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_c") / total)).alias("_q"))
    w = Window.partitionBy(group).orderBy(seeded_order(seed, F.col(key)), F.col(key))
    rows = df.withColumn("_r", F.row_number().over(w)).join(F.broadcast(quota), F.col(group).eqNullSafe(F.col("_g")))
    return rows.where(F.col("_r") <= F.col("_q")).drop("_r", "_g", "_q")


def systematic(df: DataFrame, key: str, step: int, offset: int = 0) -> DataFrame:
    """Rows whose integer key leaves `offset` modulo step."""
    return df.where(F.pmod(F.col(key), F.lit(step)) == offset)


def per_file(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of every source file."""
    named = df.withColumn("_file", F.col("_metadata.file_path"))
    return per_group(named, ["_file"], key, n, seed).drop("_file")


def bootstrap_cells(df: DataFrame, cell: Sequence[str], key: str, x: str, y: str, draws: int, per_cell: int, seed: int = 42) -> DataFrame:
    """Means, deviations and 5th and 95th percentiles over seeded draws of each cell's mean x and y, and the mean sample
    covariance. A draw takes the first per_cell rows of the cell in an order hashed with the draw's number."""
    rows = df.select(*cell, key, x, y).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(*cell, "draw").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col(key).cast("string")), 256), F.col(key))
    drawn = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_cell)
    means = drawn.groupBy(*cell, "draw").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_samp(x, y).alias("cxy"))
    p = lambda c, q: F.percentile(F.col(c), F.lit(q))
    return means.groupBy(*cell).agg(
        F.count("*").alias("draws"), F.max("n").alias("n"), F.avg("mx").alias("mean_x"), F.stddev_samp("mx").alias("std_x"), p("mx", 0.05).alias("p05_x"), p("mx", 0.95).alias("p95_x"),
        F.avg("my").alias("mean_y"), F.stddev_samp("my").alias("std_y"), p("my", 0.05).alias("p05_y"), p("my", 0.95).alias("p95_y"), F.avg("cxy").alias("covariance"),
    )
