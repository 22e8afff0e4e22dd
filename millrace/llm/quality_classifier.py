"""A quality classifier with hierarchical empirical Bayes over sites and paths.

Document evidence: a logistic model of a naive Bayes word score and a few shape measures, fitted on a bounded sample of
labelled documents (FIT_ROWS; everything after the fit covers all rows). Its log-odds, less the fitted sample's own, are the
evidence that a text gives by itself.

Site evidence: each host (for documents: the source) and each path below it (source and language) has a count and a sum of
its documents' probabilities, labelled documents counting with their label. The spread of the host means around the global
mean gives the prior strength by the method of moments; a host's posterior is its mean shrunk to the global one by that
strength, and a path's posterior is its mean shrunk likewise to its host's. So a sparse site stands near the global prior
and a large one near its own mean. Sums are grouped aggregations with map-side combining, and a document's own part is taken
out of its path's before they meet, so that no text is counted twice.

A document's posterior log-odds are those of its path's posterior plus its evidence; it is kept from probability CUT on.

Defined results: null and empty texts have neutral evidence; null hosts and paths are sites of their own; conflicting labels
of one doc_id count as good; with no or one-sided labels all evidence is 0 and every document is kept; rows that share a
doc_id are judged one by one, and the least of their texts is the one to be fitted on. Texts of any length are read whole,
one at a time; other columns play no part.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, bound_batches, materialize, slices, small_or_whole

#: Labelled documents of either kind that the model is fitted on at most, chosen by a hash of doc_id, with their whole texts.
FIT_ROWS = 4_000
#: Hash buckets of the word model.
BUCKETS = 1 << 18
CUT = 0.5
#: The strongest prior, in documents: what hosts without any spread get.
STRONGEST = 10_000.0
#: Words that a worker keeps, and bytes of texts that are worked on at once.
KEPT = 200_000
CHARACTERS = 1_000_000


def shape(words: list[bytes], text: str) -> list[float]:
    """Measures of a text's form: signs, repeats and word length."""
    n = len(words)
    size = sum(map(len, words))
    signs = sum(map(text.count, "#*$%&|<>!"))
    lines = [x for x in text.split("\n") if x]
    return [signs / (size + 1), len(set(words)) / (n + 1), len(set(lines)) / (len(lines) + 1), size / (n + 1) / 10, math.log1p(n) / 10]


class WordModel:
    """Naive Bayes log-odds of hashed words, and the logistic weights that join them with the shape."""

    def __init__(self, odds: np.ndarray, weights: np.ndarray, center: np.ndarray, scale: np.ndarray, prior: float):
        self.odds, self.weights, self.center, self.scale, self.prior = odds, weights, center, scale, prior
        self.known: dict[bytes, float] = {}

    def __reduce__(self):
        return WordModel, (self.odds, self.weights, self.center, self.scale, self.prior)

    def measures(self, text: str) -> list[float]:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = float(self.odds[zlib.crc32(w) & (BUCKETS - 1)])
        score = sum(map(known.__getitem__, words)) / (len(words) + 5)
        return [score, *shape(words, text)]

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of quality beyond the prior; 0 for texts without words."""
        x = np.array([self.measures(t) if t and not t.isspace() else self.center for t in texts]).reshape(len(texts), -1)
        z = (x - self.center) / self.scale
        out = z @ self.weights[1:] + self.weights[0] - self.prior
        out[[not t or t.isspace() for t in texts]] = 0.0
        return np.clip(out, -30, 30)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of words, and how many words each holds."""
    return np.unique(np.array([zlib.crc32(w) & (BUCKETS - 1) for w in words], np.int32), return_counts=True)


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return *word_ids(words), shape(words, text)


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], good: np.ndarray) -> WordModel | None:
    """Naive Bayes over halves of the sample (each half is scored by the other's words, so the logistic part sees word
    scores as honest as new texts have), then a ridge logistic fit by Newton steps. rows: features of texts."""
    good = np.asarray(good, float)
    if len(good) < 20 or not 0 < good.sum() < len(good):
        return None
    counts = np.zeros((2, 2, BUCKETS))
    half = np.arange(len(good)) % 2
    for (ids, _, _), g, h in zip(rows, good, half, strict=True):
        counts[h, int(g), ids] += 1.0

    def odds(c: np.ndarray) -> np.ndarray:
        return np.log((c[1] + 0.5) / (c[1].sum() + 0.5 * BUCKETS)) - np.log((c[0] + 0.5) / (c[0].sum() + 0.5 * BUCKETS))

    other = [odds(counts[1]), odds(counts[0])]
    x = np.array([[(other[h][ids] * n).sum() / (n.sum() + 5), *form] for (ids, n, form), h in zip(rows, half, strict=True)])
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - center) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (good - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    prior = math.log(good.mean() / (1 - good.mean()))
    return WordModel(odds(counts.sum(0)), w, center, scale, prior)


def _featured(batches):
    """(doc_id, good, text) to (doc_id, good, ids, n, form)."""
    for batch in batches:
        for start, texts in slices(batch.column(2), CHARACTERS):
            ids, n, form = zip(*map(features, texts), strict=True)
            lists = [pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([x.tolist() for x in n], pa.list_(pa.int32())), pa.array(form, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, len(texts)) for k in (0, 1)), *lists], ["doc_id", "good", "ids", "n", "form"])


def _scorer(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for start, texts in slices(batch.column(1), CHARACTERS):
                e = m.evidence(texts) if m else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(e)], ["rest", "evidence"])

    return run


def _training(docs: DataFrame, labels: DataFrame) -> WordModel | None:
    """The model of at most FIT_ROWS labelled documents of either kind, one row of each doc_id. What reaches the driver is
    for each the counts of its words' buckets, so no more than BUCKETS numbers however long the text is."""
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = [labels.where(F.col("good") == g).orderBy(order, "doc_id").limit(FIT_ROWS) for g in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * FIT_ROWS rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(_featured, "doc_id long, good int, ids array<int>, n array<int>, form array<double>").orderBy("doc_id").toArrow()
    parts = [[np.asarray(x.values, t) for x in found.column(k).combine_chunks()] if len(found) else [] for k, t in (("ids", np.int64), ("n", float), ("form", float))]
    return fit([(i, n, f.tolist()) for i, n, f in zip(*parts, strict=True)], found.column("good").to_numpy())


def strength(sites: DataFrame) -> float:
    """Prior strength in documents by the method of moments, from the spread of site means beyond their own sampling noise.
    sites: n, s (sum of probabilities). Only five sums reach the driver."""
    m = F.col("s") / F.col("n")
    big = sites.where("n >= 2")
    k, n, s = big.agg(F.count("*"), F.sum("n"), F.sum("s")).first()
    if not k or k < 2 or not 0 < s < n:
        return STRONGEST
    mu = s / n
    between, inverse = big.agg(F.avg((m - mu) * (m - mu)), F.avg(1 / F.col("n"))).first()
    noise = mu * (1 - mu) * inverse
    tau = between - noise
    return float(min(STRONGEST, max(1.0, mu * (1 - mu) / tau - 1))) if tau > 0 else STRONGEST


def quality_posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_posterior, path_posterior, quality, kept.

    labels: doc_id, quality. Texts are read once and never shuffled; narrow rows are aggregated by host and path."""
    bound_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") >= 1).cast("int").alias("good"))
    known = materialize(known, "known")
    sc = docs.sparkSession.sparkContext
    model = _training(docs, known)
    rest = F.struct(F.col("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"))
    texts = docs.select(rest.alias("rest"), F.col("text").alias("text"))
    schema = T.StructType().add("rest", texts.schema["rest"].dataType).add("evidence", "double")
    scored = materialize(texts.mapInArrow(_scorer(sc.broadcast(model)), schema).select("rest.*", "evidence"), "evidence")

    prior = model.prior if model else 0.0
    own = 1 / (1 + F.exp(-(F.lit(prior) + F.col("evidence"))))
    counted = scored.join(known.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left")
    counted = counted.select("doc_id", "host", "path", "evidence", F.coalesce(F.col("good").cast("double"), own).alias("p"))
    counted = materialize(counted, "counted")
    paths = materialize(counted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    total = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    mu = total[1] / total[0] if total[0] else 0.5
    mu = min(1 - 1e-6, max(1e-6, mu))
    k_host = strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s")))
    k_path = strength(paths)

    host_post = (F.col("hs") - F.col("p") + k_host * mu) / (F.col("hn") - 1 + k_host)
    h, p = hosts.withColumnRenamed("host", "of_host"), paths.withColumnsRenamed({"host": "in_host", "path": "of_path"})
    at = counted.join(small_or_whole(h, BROADCAST_ROWS // 4), F.col("host").eqNullSafe(F.col("of_host")))
    at = at.join(small_or_whole(p, BROADCAST_ROWS // 4), F.col("host").eqNullSafe(F.col("in_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    at = at.withColumn("host_posterior", host_post)
    at = at.withColumn("path_posterior", (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path))
    odds = F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) + F.col("evidence")
    quality = 1 / (1 + F.exp(-odds)) if model else F.lit(1.0)
    return at.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", quality.alias("quality"), (quality >= cut).alias("kept"))
