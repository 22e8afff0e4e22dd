"""Embedding near-dedup by sorted projection passes.

A pass orders a label's vectors lexicographically by concatenated random hashes: the signs of the centred vectors on `bits`
random hyperplanes of the pass. Its windows are the runs of the order that share all signs; the vectors of a window are
compared with each other exactly (cosine in double precision), a long window block against block, so that nothing in it is
lost to a bound. Verified pairs of all passes are united into components. A pair counts in the first pass whose window holds
both, which the vectors' codes tell, so links are counted without writing pairs.

Windows and passes follow the label. Vectors are centred by their label's mean, or the signs of a concentrated label would
tell nothing. `bits` is chosen so that windows hold about RUN vectors, and passes so that a pair at the threshold, as far
from the mean as the nearest hundredth of the label, is missed with a chance of MISS at most. Where that asks for more
comparisons than the label has pairs, or for more than PASSES passes, one pass with the whole label as its window does the
work: small and very concentrated labels are thus compared completely, and the work for the latter grows with the square of
their size. Results do not depend on partitions.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label,
link with nothing, as do vectors of different lengths. Rows with equal label and vector are one class, compared once, and
count as linked with each other; a null vec_id counts as a vector but is never a smallest id. An empty table gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, is_empty, materialize, small_or_whole
from .components import connected_components

COSINE = 0.98
#: Vectors that are compared with a block at a time, and vectors of a block while a window has at most SPLIT of them.
WINDOW = 512
BLOCK = 1024
SPLIT = 8
#: Vectors of a pass's window on average, the chance of missing a pair at the threshold, and the most passes.
RUN = 1024
MISS = 0.001
PASSES = 512
SEED = 20260401


def _read(batches):
    """(vec_id, label, vector array<double>) to (vec_id, label, dim, v): v is null where the vector links with nothing."""
    for batch in batches:
        lists, labels = batch.column(2), batch.column(1)
        out, dims = [], []
        for x, label in zip(lists, labels, strict=True):
            v = None
            if x.is_valid and label.is_valid and x.values.null_count == 0 and len(x.values):
                a = x.values.to_numpy()
                with np.errstate(over="ignore"):
                    good = np.isfinite(a).all() and 0 < np.dot(a, a) < np.inf
                v = a.astype("<f8").tobytes() if good else None
            out.append(v), dims.append(len(v) // 8 if v else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), labels, pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "v"])


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; no row is zero."""
    return m / np.sqrt((m * m).sum(1))[:, None]


def spanning(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each row reaches over the pairs x, y, where label names the least one it reached before them.
    Only least rows are hooked to lesser ones, so nothing reached before is lost."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def codes_of(u: np.ndarray, passes: int, bits: int) -> np.ndarray:
    """The signs of the rows of u on each pass's planes, as numbers."""
    out = np.zeros((len(u), passes), np.int64)
    for r in range(passes):
        planes = np.random.default_rng([SEED, u.shape[1], r]).standard_normal((bits, u.shape[1]))
        out[:, r] = (u @ planes.T > 0) @ (1 << np.arange(bits))
    return out


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _summed(batches):
    """(grp, dim, v) to (grp, dim, total): sums of unit vectors, one row for each group of a batch."""
    for batch in batches:
        grp, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for g, d in set(zip(grp.tolist(), dim.tolist(), strict=True)):
            at = pa.array(np.flatnonzero((grp == g) & (dim == d)))
            total = units(_unpacked(batch.column(2).take(at), d)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([d], pa.int32()), pa.array([total.tolist()])], ["grp", "dim", "total"])


def _centred(batches):
    """(row numbers in the batch, centred unit vectors, batch) for each group; columns grp, dim, v, centre come first."""
    for batch in batches:
        grp, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for g, d in set(zip(grp.tolist(), dim.tolist(), strict=True)):
            at = np.flatnonzero((grp == g) & (dim == d))
            yield at, units(_unpacked(batch.column(2).take(pa.array(at)), d)) - np.array(batch.column(3)[int(at[0])].as_py()), batch


def _distances(batches):
    """(grp, dim, v, centre) to (grp, dim, far): the squared distance to the centre."""
    for at, u, batch in _centred(batches):
        of = pa.array(at)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array((u * u).sum(1))], ["grp", "dim", "far"])


def _coded(batches):
    """(grp, dim, v, centre, cid, passes, bits) to (grp, dim, cid, codes)."""
    for at, u, batch in _centred(batches):
        of, first = pa.array(at), int(at[0])
        codes = codes_of(u, batch.column(5)[first].as_py(), batch.column(6)[first].as_py())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in (0, 1, 4)), lists], ["grp", "dim", "cid", "codes"])


def compared(side: np.ndarray, weight: np.ndarray, m: np.ndarray, least: float, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the summed weight of its links and the least row that it reaches: links of side 0 with side 1, or with
    each other where there is no side 1. Sides are in order; WINDOW rows are compared at a time. Pairs that share one of
    the codes (of earlier passes) are left to it."""
    n, cut = len(side), int((side == 0).sum())
    u, count, label = units(m), np.zeros(n, np.int64), np.arange(n)
    own = cut == n
    for s in range(0, cut, WINDOW):
        e = min(s + WINDOW, cut)
        at = s if own else cut
        link = u[s:e] @ u[at:].T >= least
        if own:
            link[:, : e - s] &= ~np.tri(e - s, dtype=bool)  # each pair once, no row with itself
        x, y = np.nonzero(link)
        x, y = x + s, y + at
        if codes is not None and codes.shape[1] and len(x):
            new = np.concatenate([~(codes[x[k : k + 100_000]] == codes[y[k : k + 100_000]]).any(1) for k in range(0, len(x), 100_000)])
            x, y = x[new], y[new]
        if len(x):
            np.add.at(count, x, weight[y]), np.add.at(count, y, weight[x])
            label = spanning(label, x, y)
    return count, label


_KEYS = ("grp", "dim", "r", "code", "i", "j")


def _met(least: float):
    """Rows (*_KEYS, side, cid, weight, v, codes) sorted by the first seven to (cid, n, root): the weight of each row's
    links in its group that no earlier pass has, and a row that it reaches there."""

    def run(batches):
        held = []
        for batch in _then_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
                key = [[b.column(k)[at].as_py() for k in range(len(_KEYS))] for b, at in ((held[0], 0), (batch, batch.num_rows - 1))]
                if key[0] == key[1]:
                    continue  # one group so far
            if not held:
                break
            rows = pa.Table.from_batches(held)
            keys = [rows.column(k).to_numpy() for k in range(len(_KEYS))]
            new = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
            ends = [0, *new.tolist()] + ([rows.num_rows] if batch is None else [])
            for s, e in zip(ends, ends[1:], strict=False):
                group, dim, r = rows.slice(s, e - s), int(keys[1][s]), int(keys[2][s])
                side, cid, weight = (group.column(k).to_numpy() for k in (6, 7, 8))
                codes = np.array(group.column(10).to_pylist(), np.int64).reshape(e - s, -1)[:, :r]
                n, root = compared(side, weight, _unpacked(group.column(9), dim), least, codes)
                on = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(n[on]), pa.array(cid[root[on]])], ["cid", "n", "root"])
            held = [b for b in rows.slice(ends[-1]).to_batches() if b.num_rows]

    return run


def _then_none(batches):
    yield from batches
    yield None


def coded(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(grp, dim, cid, codes) of rows (grp, dim, v, cid): a code for each pass of the row's group; one code of 0 where a
    single pass takes the group whole."""
    of = ["grp", "dim"]
    sizes = materialize(rows.groupBy(*of).agg(F.count("*").alias("n")), "sizes")
    whole = F.array(F.lit(0).cast("long")).alias("codes")
    large = sizes.where(F.col("n") > 2 * RUN)  # below that the least two passes ask for as much as all pairs
    if is_empty(large):
        return rows.select(*of, "cid", whole)
    large = rows.join(small_or_whole(materialize(large, "large")), of)
    sums = large.select(*of, "v").mapInArrow(_summed, "grp long, dim int, total array<double>").join(small_or_whole(sizes), of)
    sums = sums.select(*of, "n", F.posexplode("total").alias("k", "x")).groupBy(*of, "n", "k").agg(F.round(F.sum("x") / F.col("n"), 6).alias("x"))
    centres = materialize(sums.groupBy(*of, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre")), "centres")
    at = large.drop("n").join(small_or_whole(centres, 10_000), of)
    far = at.select(*of, "v", "centre").mapInArrow(_distances, "grp long, dim int, far double")
    far = far.groupBy(*of).agg(F.percentile_approx("far", 0.01, 1000).alias("far"))
    plan = centres.join(far, of).withColumn("bits", F.ceil(F.log2(F.col("n") / RUN)).cast("int"))
    angle = F.acos(F.greatest(F.lit(-1.0), 1 - F.lit(1 - cosine) / F.greatest("far", F.lit(1e-12))))
    plan = plan.withColumn("hit", F.pow(1 - angle / math.pi, F.col("bits")))
    passes = F.ceil(math.log(MISS) / F.log(1 - F.least(F.greatest("hit", F.lit(1e-9)), F.lit(0.999))))
    plan = plan.withColumn("passes", passes.cast("int"))
    plan = plan.where((F.col("passes") <= PASSES) & (F.col("passes") * RUN < F.col("n") / 2) & (F.col("bits") <= 62))
    plan = materialize(plan.select(*of, "centre", "passes", "bits"), "passes")
    some = rows.join(small_or_whole(plan, 10_000), of).select(*of, "v", "centre", "cid", "passes", "bits")
    some = some.mapInArrow(_coded, "grp long, dim int, cid long, codes array<long>")
    rest = rows.join(small_or_whole(plan.select(*of)), of, "left_anti").select(*of, "cid", whole)
    return materialize(some.unionAll(rest), "codes")


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    bound_batches(vectors.sparkSession)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    label = plain.schema["label"].dataType
    schema = T.StructType().add("vec_id", "long").add("label", label).add("dim", T.IntegerType()).add("v", "binary")
    rows = materialize(plain.mapInArrow(_read, schema), "vectors")
    classes = rows.where("v is not null").groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    digest = F.xxhash64("label", "v")
    classes = materialize(classes.withColumn("cid", digest), "classes")

    codes = coded(classes.withColumn("grp", F.xxhash64("label", "dim")).select("grp", "dim", "v", "cid"), cosine)
    places = codes.select("grp", "dim", "cid", "codes", F.posexplode("codes").alias("r", "code"))
    runs = places.groupBy("grp", "dim", "r", "code").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK)
    blocks = F.greatest(F.least(blocks, F.lit(SPLIT)), F.ceil(F.col("size") / (SPLIT * BLOCK))).cast("int")
    runs = materialize(runs.withColumn("nb", blocks), "runs")
    spread = places.join(small_or_whole(runs), ["grp", "dim", "r", "code"]).join(classes.select("cid", "weight", "v"), "cid")
    spread = spread.withColumn("own", F.pmod(F.xxhash64("cid"), "nb").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    spread = spread.select("grp", "dim", "r", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "cid", "weight", "v", "codes")
    spread = spread.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "side")
    met = materialize(spread.mapInArrow(_met(cosine), "cid long, n long, root long"), "met")
    counts = met.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = connected_components(met.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))

    named = comps.withColumnsRenamed({"node": "cid", "component": "comp"}).join(classes.select("cid", "rep"), "cid")
    least_id = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = named.join(least_id, "comp").join(counts, "cid", "left").select("cid", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    verdict = materialize(classes.select("cid", "rep", "weight").join(of, "cid", "left"), "verdicts")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), digest).alias("cid")).join(verdict, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.coalesce("component_id", "rep"))
    n_links = F.coalesce(F.col("weight") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
