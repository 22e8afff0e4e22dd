"""Scaling, correlation, regression and distribution tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """Columns standardised by population deviation (constant columns by 1) or to [0, 1] ("minmax"). The parameters are one
    broadcast row."""
    if kind == "standard":
        aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        value = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-10, 1.0).otherwise(F.col(f"_s_{c}"))
    else:
        aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))]
        value = lambda c: F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).otherwise(0.0)
    p = df.agg(*aggs)
    return df.join(F.broadcast(p)).withColumns({c: value(c) for c in columns}).drop(*p.columns)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) Pearson, a before b, all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged, from value counts: only distinct values are ordered in one window, not rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(column))
    ranks = counts.select(F.col(column).alias("_v"), (upto - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_ranks(average_ranks(both, a, "_ra"), b, "_rb").agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information in bits of two discrete (binned) columns."""
    j = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    wa, wb = Window.partitionBy(a), Window.partitionBy(b)
    j = j.withColumns({"na": F.sum("n").over(wa), "nb": F.sum("n").over(wb)})
    total = F.sum("n")
    # sum p log2(p / pa pb) = log2 N + sum n log2(n / (na nb)) / N
    return j.agg(total.alias("n"), (F.log2(total.cast("double")) + F.sum(F.col("n") * F.log2(F.col("n") / (F.col("na").cast("double") * F.col("nb")))) / total).alias("mi"))


def residuals(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """(key, expected, residual) of a least-squares line; its two parameters are one broadcast row."""
    line = df.agg(F.regr_slope(y, x).alias("_k"), F.regr_intercept(y, x).alias("_b"))
    expected = F.col("_b") + F.col("_k") * F.col(x)
    return df.join(F.broadcast(line)).select(key, expected.alias("expected"), (F.col(y) - expected).alias("residual"))


def ks_two_sample(df: DataFrame, flag: str, value: str) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov distance of value between rows with and without the flag."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(flag).alias("f"))
    c = rows.groupBy("v").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b"))
    w, all_ = Window.orderBy("v"), Window.partitionBy()
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(all_) - F.sum("b").over(w) / F.sum("b").over(all_))
    return c.select(gap.alias("gap"), F.sum("a").over(all_).alias("na"), F.sum("b").over(all_).alias("nb")).agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("gap").alias("ks"))


def confidence(df: DataFrame, keys: Sequence[str], value: str, full: int = 100) -> DataFrame:
    """Mean with a 95 % interval: 1.96 standard errors from `full` rows on, else 30 % of the mean to either side."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    half = 1.96 * F.col("_s") / F.sqrt("n")
    big = F.col("n") >= full
    return g.select(*keys, "n", "mean", F.when(big, F.col("mean") - half).otherwise(F.col("mean") * 0.7).alias("low"), F.when(big, F.col("mean") + half).otherwise(F.col("mean") * 1.3).alias("high"))


def clipped_histogram(df: DataFrame, by: Sequence[str], value: str, high: float, bins: int) -> DataFrame:
    """Rows of each group and bin 1..bins of equal width over [0, high]; values beyond either end count in the bin there.
    Null values are left out."""
    inside = F.least(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(float(high)))
    at = F.least(F.floor(inside / (high / bins)).cast("int") + 1, F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def clipped_summary(df: DataFrame, by: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """Per group n, mean, median and 90th percentile, and the mean with values clipped at the group's `share` percentile."""
    cut = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(share), F.lit(0.5), F.lit(0.9))).alias("q"))
    joined = df.join(cut, list(by))
    clipped = F.least(F.col(value).cast("double"), F.col("q")[0])
    means = joined.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg(clipped).alias("clipped_mean"), F.first("q").alias("q"))
    return means.select(*by, "n", "mean", F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"), "clipped_mean")
