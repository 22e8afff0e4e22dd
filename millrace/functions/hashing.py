"""Ids and hashes that do not depend on a run: SHA-256 ids, match hashes, Zobrist hashes, packed-key hashes."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import long_sum


def text_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts, trimmed, lower-cased and joined by |; null counts as empty."""
    clean = [F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *clean), 256), 1, length)


def canonical_names(one: Column, two: Column) -> Column:
    """Both names trimmed, lower-cased and in order, joined by |."""
    clean = [F.lower(F.trim(x)) for x in (one, two)]
    return F.concat_ws("|", F.least(*clean), F.greatest(*clean))


def seeded_order(seed: int, *parts: Column) -> Column:
    """A text that orders rows as at random, alike in every engine that has SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


@functools.cache
def zobrist_keys(seed: int = 0x12345678DEADBEEF) -> dict[str, list]:
    """Random 64-bit keys from an xorshift generator, as signed longs, in the fixed order in which hashes expect them."""
    mask, state = (1 << 64) - 1, seed

    def draw(n: int) -> list[int]:
        nonlocal state
        out = []
        for _ in range(n):
            state ^= state << 13 & mask
            state ^= state >> 7
            state ^= state << 17 & mask
            out.append(state - (1 << 64) if state >> 63 else state)
        return out

    keys: dict[str, list] = {"x": [draw(24) for _ in range(4)], "o": [draw(24) for _ in range(4)], "count": [draw(16) for _ in range(24)]}
    for name, n in (("bar_x", 16), ("bar_o", 16), ("off_x", 16), ("off_o", 16), ("side", 2), ("cube", 8), ("owner", 3), ("away_x", 256), ("away_o", 256)):
        keys[name] = draw(n)
    return keys


def _array(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")  # one foldable literal rather than hundreds


@functools.cache
def point_keys() -> list[int]:
    """For each point and number of checkers from -15 to 15 what it adds to a hash: the keys of its levels and its count."""
    k, out = zobrist_keys(), []
    for i in range(24):
        for n in range(-15, 16):
            key = k["count"][i][abs(n)]
            for level in range(min(4, abs(n))):
                key ^= k["x" if n > 0 else "o"][level][i]
            out.append(key)
    return out


def board_hash(board: Column, bar_x: Column, bar_o: Column, off_x: Column, off_o: Column) -> Column:
    """Zobrist hash of the signed board alone: who stands where, in four levels, and how many. One look-up for each point."""
    k, table = zobrist_keys(), _array(point_keys())
    parts = [table[F.greatest(F.least(board[i].cast("int"), F.lit(15)), F.lit(-15)) + (31 * i + 15)] for i in range(24)]
    parts += [_array(k[n])[c.cast("int")] for n, c in (("bar_x", bar_x), ("bar_o", bar_o), ("off_x", off_x), ("off_o", off_o))]
    return functools.reduce(lambda a, b: a.bitwiseXOR(b), parts)


def context_hash(board_only: Column, side: Column, cube: Column, owner: Column, away_x: Column, away_o: Column) -> Column:
    """The board's hash with side to move, cube (log2 and owner) and away scores; values beyond a key table add nothing."""
    k = zobrist_keys()
    out = board_only
    for name, c in (("side", side), ("cube", cube), ("owner", owner), ("away_x", away_x), ("away_o", away_o)):
        key = F.when(c.between(0, len(k[name]) - 1), F.get(_array(k[name]), c.cast("int"))).otherwise(F.lit(0).cast("long"))
        out = out.bitwiseXOR(key)
    return out


@F.pandas_udf(T.LongType())
def packed_hash(board: pd.Series, cube_log2: pd.Series, owner: pd.Series, away1: pd.Series, away2: pd.Series) -> pd.Series:
    """xxh64 of 32 bytes: the 26 slots as signed bytes, cube log2 and owner as bytes, both aways as u16, signed."""
    import numpy as np
    import xxhash

    n = len(board)
    rec = np.zeros(n, np.dtype([("b", "i1", 26), ("c", "u1"), ("o", "u1"), ("a", "<u2", 2)]))
    if n:
        rec["b"] = np.stack(board.to_numpy()).astype("i1")
    rec["c"], rec["o"] = cube_log2.clip(0, 255), owner.clip(0, 255)
    rec["a"][:, 0], rec["a"][:, 1] = away1.clip(0, 65535), away2.clip(0, 65535)
    raw = rec.tobytes()
    out = np.array([xxhash.xxh64_intdigest(raw[32 * i : 32 * i + 32]) for i in range(n)], np.uint64)
    return pd.Series(out.view(np.int64))


def occurrence_band(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise(">100")


def digits(array: Column, most: int = 10) -> Column:
    """The first dice of a game, each sorted, as text."""
    return F.array_join(F.transform(F.slice(array, 1, most), lambda d: F.concat(F.array_min(d).cast("string"), F.array_max(d).cast("string"))), "|")


__all__ = ["board_hash", "canonical_names", "context_hash", "digits", "long_sum", "occurrence_band", "packed_hash", "seeded_order", "text_id", "zobrist_keys"]
