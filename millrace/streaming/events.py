"""Extensions: the batch operators' nearest streaming forms. The engine that the library re-expresses has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; its checkpoint is the journal of what is done."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling or sliding window; rows later than `late` are dropped. Works on batches too."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    s = F.session_window(time, gap)
    g = events.withWatermark(time, late).groupBy(s, key).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Insert-or-ignore on a stream: repeats of a key within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there now, with exactly-once output, and stops."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
