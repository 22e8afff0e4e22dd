"""Token counts of byte-level BPE by rank-synchronous merging of whole batches.

Texts are split into pre-tokens by the vocabulary's pattern. The distinct pre-tokens that a worker has not met are laid out
as one flat symbol array with sequence numbers beside it (a ragged array). Every round looks up the ranks of neighbouring
symbols, takes each sequence's lowest, merges all its places from the left at once and closes the gaps; sequences without a
mergeable pair leave with their length, the number of surviving symbols. As merges only make pairs of higher rank, doing all
places of a rank at once equals the one-by-one rule.

Defined results: null and empty texts have 0 tokens; an added special token in a text counts as one, as the tokenizers
library does by default. Repeated rows are counted alike; long texts are counted whole, one at a time; columns other than
doc_id and the text play no part.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, slices

#: Splits text before the merges; a fixed value of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Words and pre-tokens that a worker keeps, and characters that are split before new ones are merged.
KEPT = 300_000
CHARACTERS = 1_000_000

_NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The character that stands for each byte in such vocabularies: itself if printable, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """Pair ranks of a tokenizers file, and the counts found so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without normalizer and prefix space is counted here")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words only aren't handled")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.after_space: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merged(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token; none is empty."""
        length = np.array([len(x) for x in pretokens], np.int64)
        count = length.copy()
        sym = self.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
        seq = np.repeat(np.arange(len(pretokens)), length)
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(start, len(seq)))
            least = np.minimum.reduceat(rank, start)
            live = least < _NONE
            if not live.all():
                count[seq[start[~live]]] = size[~live]
                keep = np.repeat(live, size)
                sym, seq, rank, least, size = sym[keep], seq[keep], rank[keep], least[live], size[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            first = np.concatenate(([True], np.diff(hit) != 1))  # of hits in a row every second one is taken
            run = np.arange(len(hit)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            hit = hit[run % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(sym))] if len(sym) else left
                rank[at[at == len(sym) - 1]] = _NONE
                same = seq[left] == seq[left + 1]
                rank[left[~same]] = _NONE
                left = left[same]
                rank[left] = self.rank(sym[left], sym[left + 1])
        return count

    def count_pretokens(self, lists: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens; the unknown among all lists are merged together."""
        if len(self.tokens) > KEPT:
            self.tokens.clear()
        new = list({x for ts in lists for x in ts}.difference(self.tokens))
        if new:
            self.tokens.update(zip(new, self.merged([x.encode("utf-8", "surrogatepass") for x in new]).tolist(), strict=True))
        get = self.tokens.__getitem__
        return [sum(map(get, ts)) for ts in lists]

    #: A space beside other white space or at an end: there the parts between spaces are not pre-tokenized alone.
    _odd = re.compile(r"\s | \s|^ | $")

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Between single spaces the pattern's matches never cross, so a part with its leading
        space is counted once per worker; other texts go through the pattern whole."""
        out = [0] * len(texts)
        parts, whole = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = [text]
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                out[i] += len(pieces) - 1
            for x in pieces:
                if self._odd.search(x):
                    whole.append((i, self.pattern.findall(x)))
                elif x:
                    first, *rest = x.split(" ")
                    whole.append((i, self.pattern.findall(first)))
                    parts.append((i, rest))
        if len(self.after_space) > KEPT:
            self.after_space.clear()
        new = list({x for _, xs in parts for x in xs}.difference(self.after_space))
        found = self.count_pretokens([*(self.pattern.findall(" " + x) for x in new), *(ts for _, ts in whole)])
        self.after_space.update(zip(new, found, strict=False))
        for (i, _), n in zip(whole, found[len(new) :], strict=True):
            out[i] += n
        get = self.after_space.__getitem__
        for i, xs in parts:
            out[i] += sum(map(get, xs))
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


def _counter(path: str, limit: int):
    def run(batches):
        merges = load(path)
        for batch in batches:
            for start, texts in slices(batch.column(1), CHARACTERS):
                n = np.array(merges.counts([x or "" for x in texts]), np.int64)
                n_bytes = pa.array([len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. A map over the rows: no shuffle. vocabulary_path must
    be readable on every executor."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    schema = T.StructType().add("doc_id", rows.schema["doc_id"].dataType).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return rows.mapInArrow(_counter(vocabulary_path, limit), schema)
