"""Match transcripts in the plain-text format with two numbered columns of rolls and moves."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

_LENGTH = re.compile(r"(\d+)\s+point match", re.I)
_GAME = re.compile(r"^\s*Game\s+(\d+)", re.I)
_PLAYERS = re.compile(r"^\s*(.+?)\s*:\s*(\d+)\s{2,}(.+?)\s*:\s*(\d+)\s*$")
_TURN = re.compile(r"^\s*(\d+)\)\s?(.*)$")
_PLAY = re.compile(r"(\d)(\d):\s*(.*)")


def _half(text: str, side: int, number: int, out: list, game: tuple) -> None:
    text = text.strip()
    if not text:
        return
    m = _PLAY.match(text)
    if m:
        out.append((*game, number, side, "checker", [int(m[1]), int(m[2])], m[3].strip()))
    elif re.match(r"doubles", text, re.I):
        out.append((*game, number, side, "double", None, text))
    elif re.match(r"takes|drops|passes", text, re.I):
        out.append((*game, number, side, "take" if text[0] in "tT" else "pass", None, text))
    elif re.match(r"wins", text, re.I):
        out.append((*game, number, side, "win", None, text))


def parse(text: str) -> list[tuple]:
    """(match length, game, player 1, player 2, score 1, score 2, turn, side, kind, dice, move) for every half turn."""
    out: list = []
    length, game, names, middle = 0, 0, ("", "", 0, 0), 40
    for line in text.splitlines():
        if m := _LENGTH.search(line):
            length = int(m[1])
        elif m := _GAME.match(line):
            game = int(m[1])
        elif (m := _PLAYERS.match(line)) and game:
            names = (m[1], m[3], int(m[2]), int(m[4]))
            middle = m.start(3)
        elif (m := _TURN.match(line)) and game:
            head = (length, game, *names)
            first, second = line[m.start(2) : middle], line[middle:]
            if re.search(r"\S$", first) and re.match(r"\S", second):  # the column is a little off: cut at the widest gap
                parts = re.split(r"\s{3,}", line[m.start(2) :], maxsplit=1)
                first, second = (parts + [""])[:2]
            _half(first, 1, int(m[1]), out, head)
            _half(second, 2, int(m[1]), out, head)
        elif re.match(r"^\s+Wins", line) and game:
            _half(line, 1 if len(line) - len(line.lstrip()) < middle else 2, 0, out, (length, game, *names))
    return out


_NAMES = ["match_length", "game_number", "player1", "player2", "score1", "score2", "turn", "side", "kind", "dice", "move"]
SCHEMA = "path string, match_length int, game_number int, player1 string, player2 string, score1 int, score2 int, turn int, side int, kind string, dice array<int>, move string"


def _parsed(batches):
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = parse(content.decode("utf-8", "replace"))
            columns = {"path": pa.array([path] * len(rows), pa.string())}
            columns |= {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(_NAMES, kinds, strict=True))}
            yield pa.RecordBatch.from_pydict(columns)


def parsed(files: DataFrame) -> DataFrame:
    """Half turns of all (path, content) files."""
    return files.select("path", "content").mapInArrow(_parsed, SCHEMA)
