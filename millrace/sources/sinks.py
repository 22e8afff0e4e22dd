"""Sinks: Parquet layouts, materialised tables with a manifest, upserts, run tables, reports.

Parquet has no unique keys: they are kept by deduplicating new rows and anti-joining those that are there."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.setops import keep_first
from .readers import optional


def hash_partitioned(df: DataFrame, path: str, key: str, parts: int, batch: str | None = None, mode: str = "append") -> None:
    """One file per hash part: pmod(xxhash64(key), parts), the same in every run; a batch becomes a directory, so that
    writing it again replaces it alone."""
    out = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition(parts, "part")
    if batch is None:
        out.write.mode(mode).partitionBy("part").parquet(path)
        return
    out = out.withColumn("batch", F.lit(batch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(path)


def materialise(spark: SparkSession, folder: str, tables: Mapping[str, Callable[[], DataFrame]]) -> dict[str, dict]:
    """Writes each table below folder, then manifest.json with rows and seconds; a manifest thus means that all are whole."""
    told = {}
    for name, make in tables.items():
        began = time.time()
        make().write.mode("overwrite").parquet(f"{folder}/{name}")
        told[name] = {"rows": spark.read.parquet(f"{folder}/{name}").count(), "seconds": round(time.time() - began, 3)}
    rows = [(json.dumps({"tables": told}, sort_keys=True),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return told


def new_rows(new: DataFrame, existing: DataFrame | None, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows to append for insert-or-ignore: the first of each key in the order, without keys that exist."""
    first = keep_first(new, key, order)
    return first if existing is None else first.join(existing.select(*key), list(key), "left_anti")


def insert_or_ignore(new: DataFrame, path: str, key: Sequence[str], order: Sequence[Column | str]) -> None:
    existing = optional(new.sparkSession, path)
    new_rows(new, existing, key, order).write.mode("append").parquet(path)


def replaced(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-or-replace: new rows, and the old ones whose key is not among them."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Replaces the partitions (e.g. of a run) that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def activated(runs: DataFrame, run_id: str) -> DataFrame:
    """The run table with one run active among those of its method and level of detail."""
    chosen = runs.where(F.col("run_id") == run_id).select(F.col("method").alias("_m"), F.col("lod").alias("_l"))
    same = runs.join(F.broadcast(chosen.limit(1)), (F.col("method") == F.col("_m")) & (F.col("lod") == F.col("_l")), "left")
    active = F.when(F.col("_m").isNotNull(), F.col("run_id") == run_id).otherwise(F.col("active"))
    return same.withColumn("active", active).drop("_m", "_l")


def of_active_runs(tiles: DataFrame, runs: DataFrame) -> DataFrame:
    """What a tile collection keeps: tiles of active runs."""
    return tiles.join(runs.where("active").select("run_id"), "run_id", "left_semi")


def csv_report(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """One CSV file with a header, for tables that a person reads."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def feature_matrix(df: DataFrame, columns: Sequence[str], path: str, key: str, limit: int = 1_000_000) -> int:
    """Writes the rows in key order as a .npy matrix on the driver's disk, for other tools; returns their number. More than
    `limit` rows are refused rather than cut."""
    import numpy as np

    if df.count() > limit:
        raise ValueError(f"more than {limit} rows don't go through the driver; write Parquet")
    table = df.orderBy(key).select(*(F.col(c).cast("double") for c in columns)).toArrow()
    m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in table.columns]) if len(table) else np.zeros((0, len(columns)))
    np.save(path, m)
    return len(m)
