"""Mixing sources to target weights by capped water-filling.

The total is shared by weight. A source whose share exceeds max_epochs times its size is clamped there, and what it cannot
take is shared anew, by weight, among the rest, until no share exceeds its cap. A source's target is then met by
floor(target / size) whole repetitions of all its documents and one fractional repetition: documents in the order of a
seeded hash (SHA-256, so that any engine can repeat it) until the remainder is filled, the last one included only if that
comes nearer to the target. The order is fixed by seed, doc_id and size, so reruns agree.

Documents with equal source, doc_id and size are one key with a count all the way, so no number of repeats lands in one task;
they follow each other in the order, and where the remainder ends among them, some are taken once more than the others.
mixed_documents() emits exactly the words that mixture() reports.

Defined results: sources are ordered by code point with null last, as a source of its own; a null text has no words and is
taken 0; repeated rows are documents of their own, interchangeable in the order; a total of 0 gives targets of 0; the length
of a text does not matter. Columns of docs come back from mixed_documents as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound_batches, is_empty, materialize, small_or_whole

MAX_EPOCHS = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
#: Rows of one key that are spelled out at a time.
CHUNK = 4096


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to (source, source_size, weight). Each round clamps the sources above their caps and sends two sums
    to the driver, whatever the number of sources; a round without a new clamp ends it."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        clamped = cap <= F.col("weight") * F.lit(level)
        left, weight = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        new = max(0.0, total - float(left or 0)) / float(weight) if weight else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def weighted_sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): weights repeat along the sources' code point order. Strings compare by their UTF-8
    bytes, which is code point order. One task numbers the sources: one narrow row each, not their documents."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(rank, F.lit(len(weights)))])


def hash_order(seed: int) -> Column:
    """16 hexadecimal digits that order the documents of a source."""
    return F.substring(F.sha2(F.concat_ws(" ", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")), 256), 1, 16)


def decisions(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, whole, more) for each key of (doc_id, source, size): of its n rows the
    mix takes `more` whole + 1 times and the others whole times."""
    bound_batches(sized.sparkSession)
    keys = materialize(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("h", hash_order(seed)), "sizes")
    heavy = keys.select("source", (F.col("size") * F.col("n")).alias("size"))
    sources = materialize(water_fill(materialize(weighted_sources(heavy, weights), "sources"), max_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.select(F.col("source").alias("s"), "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = small_or_whole(plan.alias("p"))

    # a source's order is cut into 4,096 buckets, of which only the one in which the remainder ends is sorted
    rows = keys.withColumn("b", F.substring("h", 1, 3))
    filled = rows.groupBy("source", "b").agg(F.sum(F.col("size") * F.col("n")).alias("in_b"))
    upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("before", F.coalesce(F.sum("in_b").over(upto), F.lit(0)))
    ends = filled.join(plan, F.col("source").eqNullSafe(F.col("s"))).where("before <= rest")
    ends = ends.groupBy("source").agg(F.max(F.struct("b", "before")).alias("end"))
    ends = materialize(ends.select(F.col("source").alias("e"), F.col("end.b").alias("end_b"), F.col("end.before").alias("before")), "ends")

    at = rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").join(small_or_whole(ends), F.col("source").eqNullSafe(F.col("e")), "left")
    at = at.drop("s", "e")
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    fit = F.floor((F.col("rest") - F.col("prior")) / F.col("size") + 0.5).cast("long")  # rows whose middle lies below the rest
    inside = at.where("b = end_b").withColumn("prior", prior)
    inside = inside.withColumn("more", F.when(F.col("size") > 0, F.least("n", F.greatest(F.lit(0).cast("long"), fit))).otherwise(0))
    before = F.coalesce(F.col("b") < F.col("end_b"), F.lit(False))
    others = at.where("b <> end_b or end_b is null").withColumn("prior", F.lit(None).cast("long")).withColumn("more", F.when(before, F.col("n")).otherwise(0))
    return inside.unionByName(others).select("doc_id", "source", "size", "n", "source_size", "target", "whole", F.col("more").cast("long").alias("more"))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): one row for each row of sized (doc_id, source, size), and the
    times that the mix takes it."""
    decided = decisions(sized, weights, max_epochs, seed)
    last = F.col("n") - 1
    chunks = decided.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(CHUNK).cast("long"))))
    rows = chunks.withColumn("i", F.explode(F.sequence("lo", F.least(F.col("lo") + CHUNK - 1, last))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("i") < F.col("more")).cast("long")).alias("copies"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    mixed = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), weights, max_epochs, seed)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns as they come. Decisions are joined to the texts
    by key, from a broadcast if they are few. Rows of a key that are not all taken alike (at most one key of a source) are
    written once with a number of their own and counted off by it, part by part."""
    decided = decisions(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), weights, max_epochs, seed)
    decided = decided.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "n", "whole", "more")
    decided = materialize(decided.where("whole + more > 0"), "decisions")
    rows = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("size"))
    same = F.col("row.doc_id").eqNullSafe(F.col("d")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))

    even = decided.where("more = 0 or more = n").select("d", "s", "z", (F.col("whole") + (F.col("more") > 0).cast("long")).alias("copies"))
    out = rows.join(small_or_whole(even), same).select("row", "copies")
    torn = decided.where("more > 0 and more < n")
    if not is_empty(torn):
        some = rows.join(small_or_whole(torn), same).withColumn("uid", F.monotonically_increasing_id())
        some = materialize(some.select("row", "d", "s", "z", "whole", "more", "uid", F.shiftright("uid", 33).alias("part")), "torn")
        upto = Window.partitionBy("d", "s", "z").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = some.groupBy("d", "s", "z", "part").agg(F.count("*").alias("in_part"))
        parts = parts.select(F.col("d").alias("pd"), F.col("s").alias("ps"), F.col("z").alias("pz"), F.col("part").alias("pp"), F.coalesce(F.sum("in_part").over(upto), F.lit(0)).alias("before"))
        on = F.col("d").eqNullSafe(F.col("pd")) & F.col("s").eqNullSafe(F.col("ps")) & (F.col("z") == F.col("pz")) & (F.col("part") == F.col("pp"))
        own = F.row_number().over(Window.partitionBy("d", "s", "z", "part").orderBy("uid"))
        some = some.withColumn("own", own).join(small_or_whole(materialize(parts, "parts")), on)
        out = out.unionAll(some.select("row", (F.col("whole") + (F.col("before") + F.col("own") <= F.col("more")).cast("long")).alias("copies")))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
