"""The 80-byte binary record of a position: reading, writing, and analysis blocks behind it.

Layout, little-endian: four u32 masks of X, four of O, 24 nibble counts, bars and borne-off checkers, side to move, cube
(log2, owner), away scores, pips u16 each, hash u64, number of blocks, padding. A block is type u8, version u8, length u16
and its payload. Fixed values: the sizes, types and field order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIZE = 80
RECORD = np.dtype([
    ("x", "<u4", 4), ("o", "<u4", 4), ("counts", "u1", 12), ("bar_x", "u1"), ("bar_o", "u1"), ("off_x", "u1"), ("off_o", "u1"), ("side", "u1"),
    ("cube", "u1"), ("owner", "u1"), ("away_x", "u1"), ("away_o", "u1"), ("pip_x", "<u2"), ("pip_o", "<u2"), ("hash", "<u8"), ("blocks", "u1"), ("pad", "u1", 14),
])
SMALL = ("bar_x", "bar_o", "off_x", "off_o", "side", "cube", "owner", "away_x", "away_o")
CHECKER, CUBE, ENGINE, MATCH, GAME = 1, 2, 3, 4, 5


def encode(board: np.ndarray, small: dict[str, np.ndarray], hashes: np.ndarray) -> bytes:
    """Records of n signed boards (n, 24), without blocks."""
    n = len(board)
    r = np.zeros(n, RECORD)
    bits = np.uint32(1) << np.arange(24, dtype=np.uint32)
    for level in range(4):
        r["x"][:, level] = ((board > level) * bits).sum(1)
        r["o"][:, level] = ((-board > level) * bits).sum(1)
    count = np.abs(board).astype(np.uint8) & 15
    r["counts"] = count[:, 0::2] | count[:, 1::2] << 4
    for k in SMALL:
        r[k] = small[k]
    point = np.arange(24)
    r["pip_x"] = (np.maximum(board, 0) * (point + 1)).sum(1) + small["bar_x"] * 25
    r["pip_o"] = (np.maximum(-board, 0) * (24 - point)).sum(1) + small["bar_o"] * 25
    r["hash"] = hashes.astype(np.int64).view(np.uint64)
    return r.tobytes()


def boards(records: np.ndarray) -> np.ndarray:
    """Signed boards (n, 24) of records."""
    count = np.empty((len(records), 24), np.int16)
    count[:, 0::2], count[:, 1::2] = records["counts"] & 15, records["counts"] >> 4
    bits = np.uint32(1) << np.arange(24, dtype=np.uint32)
    x, o = (records["x"][:, :1] & bits) > 0, (records["o"][:, :1] & bits) > 0
    return np.where(x, count, np.where(o, -count, 0)).astype(np.int16)


def valid(records: np.ndarray) -> np.ndarray:
    """Whether both sides have 15 checkers and the masks agree with the counts."""
    b = boards(records)
    full = (np.maximum(b, 0).sum(1) + records["bar_x"] + records["off_x"] == 15) & (np.maximum(-b, 0).sum(1) + records["bar_o"] + records["off_o"] == 15)
    bits = np.uint32(1) << np.arange(24, dtype=np.uint32)
    for level in range(4):
        full &= ((((records["x"][:, level : level + 1] | records["o"][:, level : level + 1]) & bits) > 0) == (np.abs(b) > level)).all(1)
    return full


def scan(content: bytes) -> tuple[np.ndarray, list[tuple[int, int, int, bytes]]]:
    """(records, blocks) of a stream; a block is (record number, type, version, payload). A cut-off end raises ValueError."""
    at, heads, blocks = 0, [], []
    while at < len(content):
        if at + SIZE > len(content):
            raise ValueError("the last record is cut off")
        heads.append(content[at : at + SIZE])
        n = content[at + SIZE - 15]
        at += SIZE
        for _ in range(n):
            if at + 4 > len(content):
                raise ValueError("a block's head is cut off")
            kind, version, size = content[at], content[at + 1], int.from_bytes(content[at + 2 : at + 4], "little")
            if at + 4 + size > len(content):
                raise ValueError("a block is cut off")
            blocks.append((len(heads) - 1, kind, version, content[at + 4 : at + 4 + size]))
            at += 4 + size
    return np.frombuffer(b"".join(heads), RECORD), blocks


def _decoded(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r, blocks = scan(content)
            b = boards(r)
            per = [[] for _ in r]
            for i, kind, version, payload in blocks:
                per[i].append({"block_type": kind, "version": version, "payload": payload})
            columns = {"path": pa.array([path] * len(r)), "record": pa.array(np.arange(len(r))), "board": pa.array(b.tolist(), pa.list_(pa.int32()))}
            columns |= {k: pa.array(r[k].astype(np.int32)) for k in SMALL} | {"pip_x": pa.array(r["pip_x"].astype(np.int32)), "pip_o": pa.array(r["pip_o"].astype(np.int32)), "hash": pa.array(r["hash"].view(np.int64) if len(r) else np.zeros(0, np.int64)), "valid": pa.array(valid(r))}
            columns["blocks"] = pa.array(per, pa.list_(pa.struct([("block_type", pa.int32()), ("version", pa.int32()), ("payload", pa.binary())])))
            yield pa.RecordBatch.from_pydict(columns)


SCHEMA = "path string, record long, board array<int>, " + ", ".join(f"{k} int" for k in SMALL) + ", pip_x int, pip_o int, hash long, valid boolean, blocks array<struct<block_type: int, version: int, payload: binary>>"


def decoded(files: DataFrame) -> DataFrame:
    """One row per record of (path, content) files."""
    return files.select("path", "content").mapInArrow(_decoded, SCHEMA)
