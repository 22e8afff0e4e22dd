"""Helpers shared by the training-data operators: scratch tables, size-checked broadcasts, distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of a word: a run of characters other than space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that part words.
SPACE = r"[\x20\x09-\x0D]"
#: Largest number of narrow rows (a few longs each) that a checked broadcast sends out.
BROADCAST_ROWS = 400_000

_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir where the cluster names it.

    Where it is unset (tests, notebooks) a temporary folder serves, but in local mode only: on a cluster a
    machine-local folder would lose rows."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/") + "/millrace"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs only a reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_whole(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most `limit`; else as it is, for a shuffled join.

    df should be a materialized table of a few narrow columns, so that counting reads only its footers."""
    return F.broadcast(df) if df.count() <= limit else df


def pieces(column: pa.Array, size: int):
    """(first row, rows) of runs of an Arrow column's rows of about `size` bytes each; a longer value is one alone."""
    ends = pc.cumulative_sum(pc.add(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), 1)).to_numpy(zero_copy_only=False)
    start, before = 0, 0
    while start < len(ends):
        end = max(start + 1, int(ends.searchsorted(before + size, side="right")))
        yield start, end - start
        start, before = end, int(ends[end - 1])


def slices(texts: pa.Array, size: int):
    """(first row, values) of the pieces of a column: only one at a time exists as Python objects."""
    for start, n in pieces(texts, size):
        yield start, texts.slice(start, n).to_pylist()


def bound_batches(spark: SparkSession) -> None:
    """Lowers the rows that a Parquet scan holds at once and the bytes of the batches that Python gets, for tables of long
    texts, unless the session has settings of its own: such batches are what fills an executor's memory."""
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) in (None, spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(key)):
            spark.conf.set(key, value)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """A number of partitions of about `each` rows: the session's shuffle partitions at least, so that all cores work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def prefix_sums(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Adds `<value>_before`, the sum over smaller keys, for a table with one row per range partition or bucket.

    Such a table has as many rows as there are partitions, so one task may order it."""
    from pyspark.sql import Window

    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}_before") for v in values))
