"""Tiles, grids and densities of points in the plane."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import mode_by

#: Zoom levels of each level of detail.
ZOOMS = {0: (0, 2), 1: (3, 5), 2: (6, 8)}


def bounds(df: DataFrame, x: str, y: str) -> tuple[float, float, float, float]:
    """(x low, y low, x high, y high); four figures reach the driver."""
    r = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return tuple(float(v) if v is not None else 0.0 for v in r)


def tiled(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], zooms: tuple[int, int]) -> DataFrame:
    """Adds zoom, tile_x and tile_y for every zoom level: coordinates scaled to [0, 1], clamped, times 2^zoom."""
    x0, y0, x1, y1 = box
    out = df.withColumn("zoom", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))))
    side = F.expr("shiftleft(1, zoom)")

    def at(c: str, low: float, high: float):
        unit = F.lit(0.0) if high <= low else F.least(F.greatest((F.col(c) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        return F.least(F.floor(unit * side).cast("int"), side - 1)

    return out.withColumns({"tile_x": at(x, x0, x1), "tile_y": at(y, y0, y1)})


@F.pandas_udf(T.BinaryType())
def gzipped(text: pd.Series) -> pd.Series:
    return text.map(lambda s: gzip.compress(s.encode(), mtime=0))


def tile_payloads(points: DataFrame, key: str, x: str, y: str, extra: list[str]) -> DataFrame:
    """(zoom, tile_x, tile_y, n, payload): each tile's points as a gzipped JSON array in key order. A tile must fit in a
    task; cap what a coarse zoom holds by sampling first, as levels of detail do."""
    rows = F.array_sort(F.collect_list(F.struct(key, x, y, *extra)))
    out = points.groupBy("zoom", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.to_json(rows).alias("json"))
    return out.select("zoom", "tile_x", "tile_y", "n", gzipped("json").alias("payload"))


def tile_meta(tiles: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return tiles.agg(F.coalesce(F.min("zoom"), zero).alias("min_zoom"), F.coalesce(F.max("zoom"), zero).alias("max_zoom"), F.count("*").alias("n_tiles"), F.coalesce(F.sum("n"), zero).alias("n_points"))


def grid(df: DataFrame, x: str, y: str, width: float, metric: str, label: str) -> DataFrame:
    """(gx, gy, n, mean, top label) of square bins of the given width, centred on its multiples."""
    g = df.withColumns({"gx": F.round(F.col(x) / width) * width, "gy": F.round(F.col(y) / width) * width})
    top = mode_by(g, ["gx", "gy"], label).select("gx", "gy", F.col(label).alias("top"))
    return g.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.avg(metric).alias("mean")).join(top, ["gx", "gy"], "left")


def raster(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], pixels: int = 256) -> DataFrame:
    """(px, py, n, level) with level = log1p(n): the figures of a density image."""
    x0, y0, x1, y1 = box

    def pixel(c: str, low: float, high: float):
        return F.least(F.floor((F.col(c) - low) / ((high - low) or 1.0) * pixels).cast("int"), F.lit(pixels - 1))

    inside = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    out = inside.groupBy(pixel(x, x0, x1).alias("px"), pixel(y, y0, y1).alias("py")).agg(F.count("*").alias("n"))
    return out.withColumn("level", F.log1p("n"))


def density(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], cells: int, width: float) -> DataFrame:
    """(gx, gy, density): a Gaussian kernel estimate on a grid. Each point reaches only the grid lines within four widths."""
    x0, y0, x1, y1 = box
    sx, sy = ((x1 - x0) or 1.0) / (cells - 1), ((y1 - y0) or 1.0) / (cells - 1)

    def near(c: str, low: float, step: float):
        a = F.greatest(F.ceil((F.col(c) - low - 4 * width) / step), F.lit(0)).cast("int")
        b = F.least(F.floor((F.col(c) - low + 4 * width) / step), F.lit(cells - 1)).cast("int")
        return F.when(a <= b, F.sequence(a, b))

    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    p = p.withColumn("gx", F.explode(near(x, x0, sx))).withColumn("gy", F.explode(near(y, y0, sy)))
    d2 = (F.col(x) - (x0 + F.col("gx") * sx)) ** 2 + (F.col(y) - (y0 + F.col("gy") * sy)) ** 2
    n = max(1, df.count())
    return p.groupBy("gx", "gy").agg((F.sum(F.exp(-d2 / (2 * width * width))) / (n * 2 * 3.141592653589793 * width * width)).alias("density"))
