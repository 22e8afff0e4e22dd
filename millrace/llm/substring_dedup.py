"""Substring dedup by sliding runs of sentences.

A text is a row of words (lower-cased, white space folded), cut into sentences of at most SENTENCE words: of every SENTENCE
words in a row, the text is cut after one that ends in `.`, `!` or `?`, else after any; where several qualify, after the one
of least hash (the last of equal ones). So a cut depends only on the SENTENCE - 1 words on either side of it, long stretches
without full stops are cut by content, and no more runs are hashed than content needs.

From every sentence's start on, the run of the sentences that make up the next SPAN_WORDS words (the last one as far as they
go) is hashed by its words alone, and the hashes are joined over all documents. Of each repeated hash the first span, by
doc_id and then position, stays; the words that any other span of the hash covers are removed.

Of SENTENCE words in a row of a repeated passage, one is followed by a cut wherever the passage stands, and SENTENCE +
SPAN_WORDS is 51: so every passage of over 50 words that repeats is found, with or without full stops, and goes but for its
first place, up to SENTENCE words at its start and SENTENCE - 1 at its end. A passage of fewer than SPAN_WORDS words is
never touched: licence lines, quotations and other short common text stay.

Defined results: texts without a repeated span come back unchanged, byte by byte; null texts stay null; texts of fewer than
SPAN_WORDS words hold no span. Rows with equal doc_id and text count as one document, so repeated rows are cut alike and do
not delete each other; null doc_ids come first in the order. Long texts are worked on one by one, others in slices of about
CHARACTERS. Other columns, whatever their names, come back as they are from remove_repeats.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, materialize, slices

#: Most words of a sentence, and words of a span.
SENTENCE = 8
SPAN_WORDS = 43
#: Characters that are worked on at once.
CHARACTERS = 1_000_000

_WORD = re.compile(r"\S+\s*")
_ENDS = frozenset(".!?")
_PLAIN = np.uint64(1 << 63)
_K = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _hashed(words: list[str]) -> np.ndarray:
    """Hashes of words, above zero; those that end a sentence are below 2**63, all others from there on."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)
    ends = np.array([w[-1:] in _ENDS for w in words], bool)
    return np.where(ends, np.maximum(h, np.uint64(1)), h | _PLAIN)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(k: np.uint64, n: int) -> np.ndarray:
    """1, k, k**2, ... modulo 2**64."""
    out = np.full(n, k, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _cut_after(h: np.ndarray) -> np.ndarray:
    """Whether a text is cut after each word: some SENTENCE words in a row have their last least hash there. Zeros part texts."""
    n, reach = len(h), np.zeros(len(h), np.int8)
    for side in (-1, 1):
        open_ = h > 0
        for d in range(1, min(SENTENCE, n)):
            mine, other = (slice(d, n), slice(0, n - d)) if side < 0 else (slice(0, n - d), slice(d, n))
            beats = h[other] >= h[mine] if side < 0 else h[other] > h[mine]
            open_[mine] &= beats
            open_[: d if side < 0 else 0] = False
            if side > 0:
                open_[n - d :] = False
            reach += open_
    return (reach >= SENTENCE - 1) & (h > 0)


def _runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, two hashes) of every span of the texts."""
    flat, sizes = [], []
    for x in texts:
        words = x.lower().split() if x else ()
        sizes.append(len(words))
        if len(words) >= SPAN_WORDS:
            flat += words
            flat.append("")
    size = np.array(sizes, np.int64)
    long_ = np.flatnonzero(size >= SPAN_WORDS)
    if not len(long_):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, 2), np.int64)
    first = np.concatenate(([0], np.cumsum(size[long_] + 1)))
    h = _hashed(flat)
    h[first[1:] - 1] = 0
    starts = np.concatenate(([False], _cut_after(h)[:-1]))
    starts[first[:-1]] = True
    start = np.flatnonzero(starts)
    of = np.searchsorted(first, start, side="right") - 1
    fits = start + SPAN_WORDS <= first[of + 1] - 1
    start, of = start[fits], of[fits]
    out = np.empty((len(start), 2), np.uint64)
    for j, value in enumerate((h, _scrambled(h))):
        up = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _powers(_K[j], len(h)), dtype=np.uint64)))
        back = np.uint64(pow(int(_K[j]), -1, 1 << 64))
        out[:, j] = _scrambled((up[start + SPAN_WORDS] - up[start]) * _powers(back, len(h))[start])
    return long_[of], (start - first[of]).astype(np.int32), out.view(np.int64)


def spans(text: str) -> list[tuple[int, tuple[int, int]]]:
    """(first word, hash) of each span of a text."""
    _, at, h = _runs([text])
    return [(int(a), (int(x), int(y))) for a, (x, y) in zip(at, h, strict=True)]


def _hashes(batches):
    """(text) to (h1), the first hash of every span."""
    for batch in batches:
        for _, texts in slices(batch.column(0), CHARACTERS):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(_runs(texts)[2][:, 0]))], ["h1"])


def _places(batches):
    """(doc_id, key, text) to (doc_id, key, at, h1, h2)."""
    for batch in batches:
        for start, texts in slices(batch.column(2), CHARACTERS):
            row, at, h = _runs(texts)
            of = pa.array(row + start)
            columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(at), *(pa.array(np.ascontiguousarray(h[:, j])) for j in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "at", "h1", "h2"])


def without(text: str, gone: list[int]) -> tuple[str, int, int]:
    """A text without the words of the spans that start at `gone`; stretches and words removed."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, kept, removed, stretches = [], 0, 0, 0
    done = 0  # words before it are dealt with
    for a in sorted(gone):
        b = a + SPAN_WORDS
        if a >= done:
            stretches += a > done or not removed
            out.append(text[kept : words[a][0]])
        removed += b - max(a, done)
        done, kept = b, words[b - 1][1]
    out.append(text[kept:])
    return "".join(out), stretches, removed


def _cut(batches):
    """(rest, text, gone) to (rest, text, n_removed, removed_words): texts without the spans that `gone` names."""
    for batch in batches:
        for start, texts in slices(batch.column(1), CHARACTERS):
            n, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, gone in enumerate(batch.column(2).slice(start, len(texts)).to_pylist()):
                if gone:
                    texts[i], n[i], words[i] = without(texts[i], gone)
            columns = [batch.column(0).slice(start, len(texts)), pa.array(texts, pa.string()), pa.array(n), pa.array(words)]
            yield pa.RecordBatch.from_arrays(columns, ["rest", "text", "n_removed", "removed_words"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(of_key, of_doc, gone): for each document with words to remove, the first words of its non-first spans.

    docs: doc_id, key, text. One hash of every span is counted first, with map-side combining; only spans whose hash
    repeats get a place and a second hash and are written. The joins to them can be split, so that a span that a third of
    all documents share meets no single task, and are shuffled at every size, so that what is moved grows in proportion."""
    counted = docs.select("text").mapInArrow(_hashes, "h1 long").groupBy("h1").agg(F.count("*").alias("c"))
    repeated = materialize(counted.where("c > 1").select("h1"), "span-hashes")  # so that the join can be split
    places = docs.mapInArrow(_places, "doc_id long, key long, at int, h1 long, h2 long")
    places = materialize(places.join(repeated.hint("merge"), "h1", "left_semi"), "spans")
    place = F.struct("doc_id", "key", "at")
    firsts = materialize(places.groupBy("h1", "h2").agg(F.min(place).alias("first")), "firsts")  # so that the join can be split
    later = places.join(firsts.hint("merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("key").alias("of_key"), F.col("doc_id").alias("of_doc")).agg(F.collect_set("at").alias("gone"))
    gone = materialize(gone, "repeats")
    discard(repeated, places, firsts)
    return gone


def _cut_texts(docs: DataFrame, text: str) -> DataFrame:
    """(rest, text, n_removed, removed_words): the cut texts, with the other columns in a struct. Texts are
    shuffled to meet the spans to remove, which are hashed and not sorted: sorting would hold the texts."""
    bound_batches(docs.sparkSession)
    key = F.xxhash64(F.col("doc_id"), F.col(text))
    gone = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col(text).alias("text")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("rest"), F.col(text).alias("text"), key.alias("key"))
    on = (F.col("key") == F.col("of_key")) & F.col("rest.doc_id").cast("long").eqNullSafe(F.col("of_doc"))
    joined = rows.join(gone.hint("shuffle_hash"), on, "left").select("rest", "text", "gone")
    schema = T.StructType().add("rest", joined.schema["rest"].dataType).add("text", "string")
    return joined.mapInArrow(_cut, schema.add("n_removed", "long").add("removed_words", "long"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with repeated spans cut out of their texts; all columns as they come."""
    cut = _cut_texts(docs, text)
    return cut.select(*(F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def repeat_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, text as cut, n_removed (stretches), removed_words, changed."""
    cut = _cut_texts(docs, text)
    return cut.select("rest.doc_id", F.col("text").alias(text), "n_removed", "removed_words", (F.col("n_removed") > 0).alias("changed"))
