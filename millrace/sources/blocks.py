"""Analysis blocks behind a record, from table-driven layouts.

Fixed values: the field lists below. All numbers are little-endian; rates and equities are scaled by 10,000. Texts have a
length byte and at most 255 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import records

_RATES = [(n, "<u2") for n in ("win", "win_g", "win_bg", "lose", "lose_g", "lose_bg")]
MOVE = np.dtype([("equity", "<i4"), *_RATES, ("equity_diff", "<i2"), ("ply", "u1"), ("reserved", "u1"), ("steps", "u1", (4, 2))])
CUBE = np.dtype([*_RATES, *((n, "<i4") for n in ("cubeless_no_double", "cubeless_double", "no_double", "double_take", "double_pass")), ("best", "u1")])
GAME = np.dtype([("game_number", "<u2"), ("score_x", "<u2"), ("score_o", "<u2"), ("winner", "i1"), ("points", "u1"), ("crawford", "u1"), ("moves", "<u2")])
ENGINE_TEXTS = ("engine", "engine_version", "met")
MATCH_TEXTS = ("player1", "player2", "event", "location", "round", "date", "annotator", "engine", "engine_version", "met")
UNUSED, BAR_OR_OFF = 255, 24


def _texts(values: list[str]) -> bytes:
    out = b""
    for v in values:
        raw = v.encode()[:255]
        out += bytes([len(raw)]) + raw
    return out


def _read_texts(data: bytes, n: int) -> tuple[list[str], int]:
    out, at = [], 0
    for _ in range(n):
        if at >= len(data) or at + 1 + data[at] > len(data):
            raise ValueError("a text is cut off")
        out.append(data[at + 1 : at + 1 + data[at]].decode("utf-8", "replace"))
        at += 1 + data[at]
    return out, at


def encode(kind: int, value: dict | list[dict]) -> bytes:
    """A block's payload."""
    if kind == records.CHECKER:
        m = np.zeros(len(value), MOVE)
        for i, v in enumerate(value):
            for k, x in v.items():
                m[i][k] = x
        return bytes([len(value)]) + m.tobytes()
    if kind in (records.CUBE, records.GAME):
        r = np.zeros(1, CUBE if kind == records.CUBE else GAME)
        for k, x in value.items():
            r[k] = x
        return r.tobytes()
    if kind == records.ENGINE:
        return _texts([value.get(k, "") for k in ENGINE_TEXTS]) + bytes([value.get("analysis", 0)])
    if kind == records.MATCH:
        return _texts([value.get(k, "") for k in MATCH_TEXTS]) + int(value.get("length", 0)).to_bytes(2, "little")
    raise ValueError(f"unknown block type {kind}")


def _plain(row: np.void) -> dict:
    return {k: row[k].tolist() for k in row.dtype.names}


def decode(kind: int, data: bytes) -> dict | list[dict]:
    """What a payload holds; ValueError if it is cut off."""
    if kind == records.CHECKER:
        if not data or len(data) < 1 + data[0] * MOVE.itemsize:
            raise ValueError("moves are cut off")
        return [_plain(r) for r in np.frombuffer(data, MOVE, data[0], 1)]
    if kind in (records.CUBE, records.GAME):
        layout = CUBE if kind == records.CUBE else GAME
        if len(data) < layout.itemsize:
            raise ValueError("the block is cut off")
        return _plain(np.frombuffer(data, layout, 1)[0])
    names = {records.ENGINE: ENGINE_TEXTS, records.MATCH: MATCH_TEXTS}[kind]
    texts, at = _read_texts(data, len(names))
    tail = 1 if kind == records.ENGINE else 2
    if at + tail > len(data):
        raise ValueError("the block is cut off")
    return dict(zip(names, texts, strict=True)) | {"analysis" if kind == records.ENGINE else "length": int.from_bytes(data[at : at + tail], "little")}


def _moves(batches):
    for batch in batches:
        out = {k: [] for k in ("path", "record", "rank", "equity", "win", "equity_diff", "steps")}
        for path, record, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i, m in enumerate(decode(records.CHECKER, payload)):
                out["path"].append(path), out["record"].append(record), out["rank"].append(i + 1)
                out["equity"].append(m["equity"] / 10000), out["win"].append(m["win"] / 10000), out["equity_diff"].append(m["equity_diff"] / 10000)
                out["steps"].append([x for s in m["steps"] for x in s])
        kinds = dict(path=pa.string(), record=pa.int64(), rank=pa.int32(), equity=pa.float64(), win=pa.float64(), equity_diff=pa.float64(), steps=pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def candidate_moves(decoded: DataFrame) -> DataFrame:
    """One row per candidate of the checker-play blocks of decoded records."""
    b = decoded.select("path", "record", F.explode("blocks").alias("b")).where(F.col("b.block_type") == records.CHECKER)
    rows = b.select("path", "record", "b.payload")
    return rows.mapInArrow(_moves, "path string, record long, rank int, equity double, win double, equity_diff double, steps array<int>")


def move_text(steps: Column) -> Column:
    """`24/20 13/8(2)` of up to four (from, to) pairs in a flat array: farthest first, repeats merged, `bar` and `off` named;
    `Cannot Move` if there are none."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(steps, i * 2).alias("a"), F.get(steps, i * 2 + 1).alias("b"), i.alias("i")))
    ended = F.coalesce(F.array_min(F.transform(F.filter(pairs, lambda p: p["a"].isNull() | (p["a"] == UNUSED)), lambda p: p["i"])), F.lit(4))
    used = F.array_sort(F.transform(F.slice(pairs, 1, ended), lambda p: F.struct((-p["a"]).alias("o"), p["i"], p["b"])))

    def name(point: Column, edge: str) -> Column:
        return F.when(point == BAR_OR_OFF, edge).otherwise((point + 1).cast("string"))

    start = F.array().cast("array<struct<t:string,n:int>>")

    def add(acc: Column, p: Column) -> Column:
        text = F.concat(name(-p["o"], "bar"), F.lit("/"), name(p["b"], "off"))
        last = F.get(acc, F.size(acc) - 1)
        again = (F.size(acc) > 0) & (last["t"] == text)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(text.alias("t"), (last["n"] + 1).alias("n"))))
        return F.when(again, grown).otherwise(F.concat(acc, F.array(F.struct(text.alias("t"), F.lit(1).alias("n")))))

    def shown(acc: Column) -> Column:
        return F.array_join(F.transform(acc, lambda x: F.when(x["n"] > 1, F.concat(x["t"], F.lit("("), x["n"].cast("string"), F.lit(")"))).otherwise(x["t"])), " ")

    text = F.aggregate(used, start, add, shown)
    return F.when(ended == 0, "Cannot Move").otherwise(text)
