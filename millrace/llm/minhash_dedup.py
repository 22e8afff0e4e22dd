"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch follows Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017): in round i < t every shingle
is hashed to one of t bins with a value in [i, i+1), and in round i >= t to bin i - t; each bin keeps its least value. Bins
that an earlier round filled never change, so after about (t log t) / |set| rounds all are filled, t further rounds
guarantee it, and the share of equal coordinates of two sketches concentrates around the Jaccard similarity as t
independent minima would.

Defined results: words are lower-cased in A-Z only; a text of fewer than five words is one shingle; null, empty and
wordless texts have no shingles and link with nothing. Rows with equal shingle sets are one class and are sketched once in
every later step. Each row is judged by itself: repeated rows get equal results. A null doc_id is never a smallest id; a
group of such rows alone has a null component and keeps them. Set elements are 64-bit hashes of shingles. Texts of any
length are held one at a time with their shingles; columns other than doc_id and the text play no part. keep_first_of_groups
leaves exactly one row of each group, also where doc_ids repeat or are null, and every row without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, is_empty, materialize, pieces, slices, small_or_whole
from .components import connected_components

SHINGLE = 5
COORDINATES = 128
ROWS = 4
BANDS = COORDINATES // ROWS
#: Members of a bucket that one block of the last round compares with another block, and about the most bytes of their sets.
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Characters of texts that are worked on at once.
CHARACTERS = 1_000_000
#: Standard deviations below the threshold at which a pair's sketches rule it out.
SIGMAS = 5.4

_ROUND = np.uint64(56)
_VALUE = np.uint64((1 << 56) - 1)
_EMPTY = np.uint64(2**64 - 1)
_K = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(20170917).integers(0, 2**64, 2 * COORDINATES, dtype=np.uint64)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text. bytes.lower() and bytes.split() know ASCII only, as asked for."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        acc = np.array([n], np.uint64)
        for x in h:
            acc = acc * _K + x
        return mix(acc)
    acc = h[: n - SHINGLE + 1] * _K
    for j in range(1, SHINGLE):
        acc += h[j : n - SHINGLE + 1 + j]
        acc *= _K
    return np.unique(mix(acc))


def sketch(s: np.ndarray) -> np.ndarray:
    """The least value of each bin over all rounds; s is not empty. Rounds run in batches of about 1,000 hashes."""
    t = COORDINATES
    out = np.full(t, _EMPTY)
    i, step = 0, 1 + 1000 // len(s)
    while i < t:
        rounds = np.arange(i, min(t, i + step), dtype=np.uint64)[:, None]
        h = mix(s[None, :] + _SALT[i : i + step][: len(rounds), None])
        np.minimum.at(out, (h >> np.uint64(57)).astype(np.int64).ravel(), ((h & _VALUE) | (rounds << _ROUND)).ravel())
        i += step
        if (out != _EMPTY).all():
            return out
    for j in np.flatnonzero(out == _EMPTY):
        out[j] = (mix(s + _SALT[t + j]) & _VALUE).min() | np.uint64(t + j) << _ROUND
    return out


def bands(sk: np.ndarray) -> np.ndarray:
    x = sk.reshape(BANDS, ROWS)
    acc = _BAND * _K
    for j in range(ROWS):
        acc = (acc + x[:, j]) * _K
    return mix(acc).view(np.int64)


def _long(x: list, typ=pa.int64()) -> pa.Array:
    return pa.array(x, typ)


def _sketched(batches):
    """(doc_id, key, text) to (doc_id, key, cid, cid2, n, bands, sk)."""
    for batch in batches:
        for start, texts in slices(batch.column(2), CHARACTERS):
            cid, cid2, n, band, sk = [], [], [], [], []
            for text in texts:
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    cid.append(None), cid2.append(None), band.append(np.zeros(0, np.int64)), sk.append(b"")
                    continue
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
                cid.append(int(a)), cid2.append(int(b))
                k = sketch(s)
                band.append(bands(k))
                sk.append(mix(k).astype(np.uint16).tobytes())
            at = np.cumsum([0] + [len(x) for x in band]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(band)))
            own = [batch.column(k).slice(start, len(texts)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, _long(cid), _long(cid2), _long(n), lists, pa.array(sk, pa.binary())], ["doc_id", "key", "cid", "cid2", "n", "bands", "sk"])


def _sets(batches):
    """(text) to (cid, set)."""
    for batch in batches:
        for _, texts in slices(batch.column(0), CHARACTERS):
            sets = [shingles(x) for x in texts]
            cid = [int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")[0]) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([_long(cid), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "set"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x and y| >= percent * |x or y|, for sorted sets that are not empty."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verifier(percent: int):
    def verify(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                keep[i] = similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return verify


def _blocks(least: int, percent: int):
    """Rows (bk, i, j, side, cid, comp, band, sk, set) sorted by (bk, i, j, side) to links (a, b) that join components.

    side 0 belongs to block i, side 1 to block j; on the diagonal all rows have side 0. A pair is looked at in every bucket
    that its members share, if their components differ and their sketches agree in `least` coordinates."""

    def links_of(rows: dict) -> list[tuple[int, int]]:
        sk, comp, side, cid = rows["sk"], rows["comp"].copy(), rows["side"], rows["cid"]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inner = not len(right)
        right = left if inner else right
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        n = np.array([len(x) for x in sets])
        found = []
        for k in range(0, len(left), 32):
            x = left[k : k + 32]
            ok = comp[x][:, None] != comp[right][None, :]
            ok &= 100 * np.minimum(n[x][:, None], n[right][None, :]) >= percent * np.maximum(n[x][:, None], n[right][None, :])
            if inner:
                ok &= cid[x][:, None] < cid[right][None, :]
            p, q = np.nonzero(ok)
            p, q = x[p], right[q]
            for m in range(0, len(p), 10_000):
                same = sk[p[m : m + 10_000]] == sk[q[m : m + 10_000]]
                near = same.sum(1) >= least
                for u, v in zip(p[m : m + 10_000][near].tolist(), q[m : m + 10_000][near].tolist(), strict=True):
                    if comp[u] != comp[v] and similar(sets[u], sets[v], percent):
                        found.append((int(cid[u]), int(cid[v])))
                        comp[comp == comp[v]] = comp[u]
        return found

    def run(batches):
        names = ("bk", "i", "j", "side", "cid", "comp", "band")
        held = None
        for batch in _then_none(batch.slice(*piece) for batch in batches for piece in pieces(batch.column(8), BLOCK_BYTES)):
            if batch is not None:
                rows = {k: batch.column(x).to_numpy(zero_copy_only=False) for x, k in enumerate(names)}
                rows["sk"] = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                rows["set"] = np.array([*batch.column(8).to_pylist(), None], object)[:-1]
                held = rows if held is None else {k: np.concatenate([held[k], rows[k]]) for k in rows}
            if held is None:
                break
            new = np.flatnonzero((np.diff(held["bk"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
            ends = [0, *new.tolist()] + ([len(held["bk"])] if batch is None else [])
            found = []
            for s, e in zip(ends, ends[1:], strict=False):
                found += links_of({k: v[s:e] for k, v in held.items()})
            held = {k: v[ends[-1] :] for k, v in held.items()}
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _then_none(batches):
    yield from batches
    yield None


def grouped(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, key (a hash of doc_id and text), n_shingles, group (null without shingles),
    component_id. near_duplicates has the rules.

    A bucket's rows are never paired with each other at large. First each is compared with the bucket's most connected
    class, which joins nearly every group. Only buckets that then still hold several components are compared in full,
    block against block: pairs of different components whose sketches lie within 5.4 standard deviations of the threshold
    are checked exactly there, and only links that join components come out; so no such link is lost to a cap."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("key"), F.col(text).alias("text"))
    rows = materialize(texts.mapInArrow(_sketched, "doc_id long, key long, cid long, cid2 long, n long, bands array<long>, sk binary"), "sketches")

    classes = materialize(rows.where("n > 0").groupBy("cid", "cid2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = rows.alias("r").join(classes.alias("c"), F.expr("r.cid = c.cid and r.cid2 = c.cid2 and r.doc_id <=> c.rep"))
    firsts = firsts.select("r.cid", "r.bands").dropDuplicates(["cid"])
    buckets = firsts.select("cid", F.posexplode("bands").alias("band", "bk"))
    shared = buckets.groupBy("bk").agg(F.count("*").alias("c"), F.min("cid").alias("one")).where("c > 1").select("bk", "c")
    members = materialize(buckets.join(shared, "bk"), "buckets")

    ids = materialize(members.select("cid").distinct().join(classes, "cid").select("rep").distinct(), "candidates")
    sets = texts.join(small_or_whole(ids), texts["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text")
    sets = materialize(sets.mapInArrow(_sets, "cid long, set binary").where("cid is not null"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("cid").alias("a"), F.col("set").alias("x"))
        y = sets.select(F.col("cid").alias("b"), F.col("set").alias("y"))
        full = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return materialize(full.mapInArrow(_verifier(percent), "a long, b long").distinct(), "links")

    degree = members.groupBy("cid").agg(F.sum("c").alias("degree"))
    hubs = members.join(degree, "cid").groupBy("bk").agg(F.max(F.struct("degree", "cid"))["cid"].alias("hub"))
    stars = members.join(hubs, "bk").where("cid <> hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
    links = verified(stars.distinct())
    comps = connected_components(links)

    of = comps.select(F.col("node").alias("cid"), F.col("component").alias("comp"))
    at = members.join(of, "cid", "left").select("bk", "band", "cid", F.coalesce("comp", "cid").alias("comp"))
    open_ = at.groupBy("bk").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bk", "c")
    rest = materialize(at.join(open_, "bk"), "open")
    if not is_empty(rest):
        info = rows.join(rest.select("cid").distinct(), "cid").select("cid", "sk", "n").dropDuplicates(["cid"])
        load = rest.join(info, "cid").groupBy("bk").agg(F.sum(F.col("n") * 8).alias("bytes"))
        info = info.drop("n").join(sets.dropDuplicates(["cid"]), "cid")
        spread = rest.join(load, "bk").withColumn("nb", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
        spread = spread.withColumn("own", F.pmod(F.xxhash64("cid"), "nb").cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).join(info, "cid")
        spread = spread.select("bk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "comp", "band", "sk", "set")
        spread = spread.repartition("bk", "i", "j").sortWithinPartitions("bk", "i", "j", "side")
        p = percent / 100
        least = int(COORDINATES * p - SIGMAS * (COORDINATES * p * (1 - p)) ** 0.5)
        more = materialize(spread.mapInArrow(_blocks(least, percent), "a long, b long").distinct(), "links")
        if not is_empty(more):
            comps = connected_components(links.unionAll(more))
    discard(members, rest, sets, ids)

    named = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "cid2", "rep", F.coalesce("component", "cid").alias("component"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    verdict = materialize(named.join(least_id, "component").select("cid", "cid2", "component", "component_id"), "verdicts")
    out = rows.select("doc_id", "key", "n", "cid", "cid2").join(verdict, ["cid", "cid2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("component").alias("group"), component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A and B| >= percent * |A or B| on their full sets; percent is at least 80, for which 32
    bands of 4 coordinates miss a linked pair with a chance below 1e-7; where pairs join components, 16-bit sketches may
    rule a pair out 5.4 standard deviations below the threshold, which is as rare."""
    out = grouped(docs, percent, doc_id, text)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first_of_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group, of the smallest doc_id; columns as they come.

    Rows that leave are named by doc_id and a hash of the text, in a broadcast if they are few, else in a join. Where
    several rows of a group have its smallest doc_id (or all are null), the one with the least hash of text and row stays,
    found by an aggregation that combines map-side."""
    verdict = materialize(grouped(docs, percent).where("n_shingles > 0"), "groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = verdict.where(~first).select("doc_id", "key").distinct()
    several = verdict.where(first).groupBy("group").agg(F.count("*").alias("c")).where("c > 1").select("group")
    several = materialize(verdict.where(first).join(several, "group").select("doc_id", "key", "group").distinct(), "several")
    gone = materialize(gone.unionAll(several.select("doc_id", "key")).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")), "dropped")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key"))
    same = (F.col("key") == F.col("gone_key")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id"))
    out = rows.join(small_or_whole(gone), same, "left_anti").select("row")
    if not is_empty(several):
        of = several.select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "group")
        mine = (F.col("key") == F.col("of_key")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("of_id"))
        one = rows.join(small_or_whole(of), mine).groupBy("group").agg(F.min_by("row", F.struct("key", F.xxhash64(F.to_json("row")))).alias("row"))
        out = out.unionAll(one.select("row"))
    return out.select("row.*")
