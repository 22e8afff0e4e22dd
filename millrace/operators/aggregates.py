"""Aggregations: profiles, histograms, percentiles, entropies, contrasts. All combine map-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import rate, width_bin


def cells(df: DataFrame, keys: list[str], metric: str, flags: Mapping[str, Column], least: int = 20) -> DataFrame:
    """Per cell: n, avg and sample deviation of a metric and rates of flags; cells with fewer rows drop out."""
    aggs = [F.count("*").alias("n"), F.avg(metric).alias("avg_metric"), F.stddev_samp(metric).alias("std_metric")]
    return df.groupBy(*keys).agg(*aggs, *(rate(f).alias(name) for name, f in flags.items())).where(F.col("n") >= least)


def regroup(cell: DataFrame, keys: list[str], weight: str = "n", metric: str = "avg_metric") -> DataFrame:
    """Coarser cells from finer ones, averages weighted by their rows."""
    total = F.sum(weight)
    return cell.groupBy(*keys).agg(total.alias("n"), (F.sum(F.col(metric) * F.col(weight)) / total).alias("avg_metric"))


def profile(df: DataFrame, keys: list[str], metric: str, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """n, mean, median, p90 and deviation of a metric and the rates at which it reaches thresholds, by any key."""
    m = F.col(metric)
    aggs = [F.count("*").alias("n"), F.avg(m).alias("mean"), F.percentile(m, F.lit(0.5)).alias("median"), F.percentile(m, F.lit(0.9)).alias("p90"), F.stddev_samp(m).alias("std")]
    return df.groupBy(*keys).agg(*aggs, *(rate(m >= t).alias(name) for name, t in (thresholds or {}).items()))


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key, ties to the least value; nulls are not counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    top = F.min(F.struct((-F.col("_n")).alias("m"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(top.alias("t")).select(*keys, F.col("t.v").alias(value), (-F.col("t.m")).alias("n"))


def width_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, low, high) of occupied bins; bin 0 is below low, bins + 1 from high on."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(width_bin(v, low, high, bins).alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def round_histogram(df: DataFrame, value: str, per_unit: int) -> DataFrame:
    """Counts of values rounded to 1 / per_unit."""
    return df.groupBy((F.round(F.col(value) * per_unit) / per_unit).alias("bin")).agg(F.count("*").alias("n"))


def labelled_counts(df: DataFrame, buckets: Mapping[str, Column]) -> DataFrame:
    """(label, n) for overlapping or disjoint conditions, in one pass."""
    one = df.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(buckets.values())))
    rows = F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"c{i}").alias("n")) for i, k in enumerate(buckets)))
    return one.select(F.inline(rows))


def percentiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles by linear interpolation as columns p<percent>. Where a group's values outgrow one task use
    approximate=percentile_approx on the caller's side."""
    aggs = [F.percentile(F.col(value), F.lit(p)).alias(f"p{round(p * 100):02d}") for p in at]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *aggs)


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of a value's distribution per key; null values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    # H = log2(N) - sum(n log2 n) / N
    h = F.log2(n.cast("double")) - F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))) / n
    return counts.groupBy(*keys).agg(n.alias("n"), F.count("*").alias("n_values"), h.alias("entropy"))


def lag_correlation(pairs: DataFrame, keys: list[str], a: str, b: str, least: int = 30) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).where(F.col("n") >= least)


def hotspots(cell: DataFrame, value: str, z: float = 1.0) -> DataFrame:
    """Cells whose value is at least the cells' mean plus z sample deviations. The two figures come as one broadcast row."""
    stats = cell.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return cell.join(F.broadcast(stats)).where(F.col(value) >= F.col("_m") + z * F.col("_s")).drop("_m", "_s")


def between_groups_threshold(df: DataFrame, keys: list[str], value: str, low: Column, high: Column, least: int = 10) -> DataFrame:
    """Per key the middle of the low group's 90th and the high group's 10th percentile, null unless both hold `least` rows."""
    a, b = F.when(low, F.col(value)), F.when(high, F.col(value))
    out = df.groupBy(*keys).agg(F.count(a).alias("n_low"), F.count(b).alias("n_high"), F.percentile(a, F.lit(0.9)).alias("p90"), F.percentile(b, F.lit(0.1)).alias("p10"))
    enough = (F.col("n_low") >= least) & (F.col("n_high") >= least)
    return out.withColumn("threshold", F.when(enough, (F.col("p90") + F.col("p10")) / 2))


def z_scores(df: DataFrame, group: list[str], within: list[str], value: str, strong: float = 1.0) -> DataFrame:
    """Mean of value per group, as deviations from the mean of the groups that share `within`, labelled by sign."""
    means = df.groupBy(*within, *group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    w = Window.partitionBy(*within)
    z = F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_samp("mean").over(w))
    return means.withColumn("z", z).withColumn("label", F.when(F.col("z") >= strong, "weak").when(F.col("z") <= -strong, "strong").otherwise("usual"))


def cooccurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, both, either, jaccard) of items that share a key, a < b. Items per key should be few: pairs are made inside
    each key's set of distinct items."""
    items = df.select(key, item).distinct()
    counts = items.groupBy(item).agg(F.count("*").alias("n"))
    sets = items.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = sets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("both"))
    na, nb = counts.select(F.col(item).alias("a"), F.col("n").alias("na")), counts.select(F.col(item).alias("b"), F.col("n").alias("nb"))
    out = both.join(na, "a").join(nb, "b").withColumn("either", F.col("na") + F.col("nb") - F.col("both"))
    return out.select("a", "b", "both", "either", (F.col("both") / F.col("either")).alias("jaccard"))


def share_of_parent(df: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """Counts per (parent, child) and their share of the parent's rows, with one shuffle on the parent."""
    counts = df.groupBy(*parent, *child).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*parent)))


def contrast(df: DataFrame, flag: Column, features: Sequence[str]) -> DataFrame:
    """(feature, mean_in, mean_out, difference) of rows with and without the flag, in one pass."""
    one = df.agg(*(F.avg(F.when(flag, F.col(f))).alias(f"i{k}") for k, f in enumerate(features)), *(F.avg(F.when(~flag, F.col(f))).alias(f"o{k}") for k, f in enumerate(features)))
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"i{k}").alias("mean_in"), F.col(f"o{k}").alias("mean_out"), (F.col(f"i{k}") - F.col(f"o{k}")).alias("difference")) for k, f in enumerate(features)))
    return one.select(F.inline(rows))


def crosstab_shares(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Shares of each row key's rows by the given column values, one column each."""
    n = F.count("*")
    return df.groupBy(row).agg(n.alias("n"), *((F.count_if(F.col(column) == v) / n).alias(f"share_{v}") for v in values))


def five_numbers(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    at = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return df.groupBy(*keys).agg(*(F.percentile(F.col(value), F.lit(p)).alias(k) for k, p in at.items()))


def gammon_rates(df: DataFrame, keys: Sequence[str], won: Column, gammon: Column) -> DataFrame:
    """Games, share of gammons among all, and among won games only."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), rate(gammon).alias("rate_all"), F.avg(F.when(won, gammon.cast("double"))).alias("rate_won"))
