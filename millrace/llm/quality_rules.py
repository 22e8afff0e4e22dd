"""Quality rules whose cutoffs come from labelled holdouts by exact binomial tests. DataFrame functions only.

A rule rejects a document whose measure exceeds a cutoff. Cutoffs are tried from a fixed grid, so that no label has a part
in proposing them. For stratum s, rule r and cutoff c let n be the labelled good documents of s that pass the base rules
and k those among them that r rejects at c. The pair is safe if a Binomial(n, limit / rules) count is at most k with
probability at most confidence_loss / (strata * rules * cutoffs): the exact (Clopper-Pearson) upper bound of the false
rejection rate then lies below limit / rules. By the union bound over all tests, with probability 1 - confidence_loss no
stratum loses more than `limit` of its good documents. Each rule takes its strictest safe cutoff; a stratum or rule without
enough labels for any rejects nothing.

Defined results: a null text has no words; a null stratum is a stratum of its own; conflicting labels of one doc_id count
as good; labels with a null doc_id or quality are not used; rows that share a doc_id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, bound_batches, materialize, small_or_whole

#: Measures, as SQL over the base counts, and the cutoffs each is tried at, strict to lenient.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)),
    "long_words": ("word_chars / greatest(n_words, 1)", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-4.6, -4.4, -4.2, -4.0, -3.75, -3.5, -3.0, -2.5, -2.0)),
}
#: Share of a stratum's good documents that all rules together may reject, and the chance that the promise fails.
LIMIT = 0.05
CONFIDENCE_LOSS = 0.05


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often a lambda inside body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Distinct hashes prove that all windows differ; only texts
    without that proof sort the windows themselves, so hash collisions cannot change the count."""

    def window_ids(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def exact(w: Column) -> Column:
        windows = F.array_sort(F.transform(window_ids(w), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i"))))

        def covered(s: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(s) - 1)
            again = F.filter(at, lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["g"] == s[j]["g"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["g"] == s[j]["g"])))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda j: F.array(s[j]["i"], s[j]["i"] + 1, s[j]["i"] + 2)))))

        return let(windows, covered)

    def quick(w: Column) -> Column:
        hashes = F.transform(window_ids(w), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact(w)))

    return F.when(F.size(words) < 4, 0).otherwise(quick(words))


def measures(text: Column) -> Column:
    """A struct of the base counts of a text, all long: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, f"{SPACE}+"), lambda w: w != "")
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeated_words(w).alias("r")))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))

    def packed(pair: Column) -> Column:
        return F.struct(
            pair["w"]["n"].cast("long").alias("n_words"),
            pair["w"]["c"].cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            pair["l"]["d"].cast("long").alias("n_dup_lines"),
            pair["w"]["r"].cast("long").alias("n_repeat_words"),
            pair["l"]["n"].cast("long").alias("n_lines"),
        )

    return let(F.struct(of_words.alias("w"), of_lines.alias("l")), packed)


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def binomial_tail_log(n: Column, k: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), summed in logarithms so that no term underflows, for k of at most n."""
    import math

    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")))

    def add(acc: Column, i: Column) -> Column:
        def summed(term: Column) -> Column:
            total = F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))
            return F.struct(term.alias("term"), total.alias("total"))

        return let(acc["term"] + F.log((n - i + 1) / i) + F.lit(math.log(p) - math.log1p(-p)), summed)

    return F.aggregate(steps, start, add, lambda acc: acc["total"])


def safe_cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, loss: float = CONFIDENCE_LOSS) -> DataFrame:
    """One row per stratum: stratum and a nullable cutoff for each rule. measured: doc_id, stratum and the base counts."""
    import math

    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good = 1").select("doc_id")
    held = measured.where(f"not {BASE_FAILED}").join(good, "doc_id", "left_semi")
    tests = [(rule, cut) for rule, (_, grid) in RULES.items() for cut in grid]
    counts = [F.sum(F.when(F.expr(f"{RULES[rule][0]} > {cut}"), 1).otherwise(0)).alias(f"k{i}") for i, (rule, cut) in enumerate(tests)]
    counted = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "holdouts")
    allowed = math.log(loss) - math.log(max(1, counted.count()) * len(tests))
    each = limit / len(RULES)
    listed = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cut"), F.col(f"k{i}").alias("k")) for i, (rule, cut) in enumerate(tests)))
    rows = counted.select("stratum", "n", F.inline(listed))
    possible = F.col("k") <= F.col("n") * each  # beyond it no bound can hold
    safe = rows.where(possible).where(binomial_tail_log(F.col("n"), F.col("k"), each) <= allowed)
    return safe.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"cut_{rule}") for rule in RULES))


def _rejected() -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.expr(f"{measure} > cut_{rule}"), F.lit(False)) for rule, (measure, _) in RULES.items()))


def _measured(docs: DataFrame, text: str, stratum: str) -> DataFrame:
    key = F.xxhash64(F.col("doc_id"), F.col(text), F.col(stratum))
    m = docs.select(F.col("doc_id"), F.col(stratum).alias("stratum"), key.alias("key"), measures(F.col(text)).alias("m"))
    return m.select("doc_id", "stratum", "key", "m.*")


def _judged(docs: DataFrame, labels: DataFrame, text: str, stratum: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    measured = materialize(_measured(docs, text, stratum), "measures")
    cuts = materialize(safe_cutoffs(measured, labels), "cutoffs").withColumnRenamed("stratum", "of")
    joined = measured.join(small_or_whole(cuts), F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = F.expr(BASE_FAILED)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~_rejected())


def quality_verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept. The texts are read once and never shuffled."""
    out = _judged(docs, labels, text, stratum)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that pass, all their columns. Texts are measured once; the rejected rows are then left out by doc_id
    and a hash of the row, from a broadcast while they are few, so that texts are only shuffled where they are many."""
    bad = _judged(docs, labels, text, stratum).where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    bad = materialize(bad, "rejected")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id"), F.col(text), F.col(stratum)).alias("key"))
    same = (F.col("key") == F.col("bad_key")) & F.col("row.doc_id").eqNullSafe(F.col("bad_id"))
    return rows.join(small_or_whole(bad), same, "left_anti").select("row.*")
