"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The lattice of a text has its characters' boundaries as nodes and every piece of the model that occurs as an edge; a
character that is no piece by itself has an edge of ten below the least piece score and is written in byte pieces. A
segmentation's score is the sum of its pieces' scores. Forward Viterbi gives the best score from the start to every node.
These are exact costs to go for a search that builds segmentations backward from the end, so A-star with them pops complete
segmentations best first and does no work beyond the N asked for.

No piece holds a space after another character (checked when a model is loaded; else a text is one segment), so the lattice
falls apart at spaces and around characters without a piece. Words are therefore solved once per worker and kept up to a
fixed size. The forward pass gives each segment's best score and the least loss of leaving its best path; only the N - 1
segments of a text with the least losses can take part in its N best segmentations, and only they are searched.

The search holds paths as links to their parents and leaves out what N segmentations already known are as good as, so its
memory grows with the segment's length alone: an unbroken text of any length is one segment.

Defined results: a null or empty text has no pieces and one segmentation, the empty one. Of ties at the last of the N places
the one found first stays, the same in every run. Decoding turns the sign U+2581 into a space, so texts that hold it come
back with spaces. The model file may be of either kind; its scores are read as given. Repeated rows are encoded alike. A
column of the caller that is named like one of the results gives way to it; all others come back as they are.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, slices

N_BEST = 4
#: Size of the segments that a worker keeps, in characters, each with OVERHEAD more.
KEPT = 10_000_000
OVERHEAD = 24
SHORT = 8
#: Bytes of texts that are cut at once, and characters of segments that are solved at once.
CHARACTERS = 4_000_000
SOLVED = 200_000
UNKNOWN_PENALTY = 10.0
#: Stands between segments where characters are numbers, and is none (NUL is one).
APART = (1 << 21) - 1


def proto_fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message: varints as int, everything else as bytes."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            out.append((tag >> 3, varint()))
            continue
        size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
        out.append((tag >> 3, data[at : at + size]))
        at += size
    return out


class Model:
    """Pieces, scores and the normalizer's settings of a .model file, and the segments solved so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            normalizer = dict(proto_fields(next(v for k, v in proto_fields(f.read()) if k == 3)))
        self.prefix = bool(normalizer.get(3, 1))
        self.plain = not normalizer.get(2) and not normalizer.get(4, 1) and bool(normalizer.get(5, 1))
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b""] * n
        self.byte_ids = [None] * 256
        usable = {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                b = int(name[3:5], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usable[name] = (i, sp.get_score(i))
                self.bytes_of[i] = name.replace("▁", " ").encode()
        self.unk = sp.unk_id()
        self.unknown_score = min(s for _, s in usable.values()) - UNKNOWN_PENALTY
        self._number(usable)
        #: A tree of characters: (the tree after it or None, (id, score) of the piece that ends there or None). A space
        #: stands beside the sign for it.
        self.tree: dict[str, tuple] = self._tree(usable)
        self.start = 1 if self.prefix else 0
        self.segments = re.compile(self._segments(usable))
        self.forget()

    @staticmethod
    def _segments(pieces) -> str:
        """A pattern whose matches no piece crosses. A match is spaces and what follows up to the next space, a character
        without a piece, or an ASCII sign after a Latin letter or digit if no piece holds two such in a row."""
        if any("▁" in x.lstrip("▁") for x in pieces):
            return "(?s).+"
        alone = "".join(c for c in "\n\r\t" if c not in set("".join(pieces)))
        latin = "0-9A-Za-zÀ-ɏ"
        joined = {m[1] for p in pieces for m in re.finditer(f"(?<=[{latin}])(.)", p)}
        signs = re.escape("".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in joined))
        one = f"[{alone}]|" if alone else ""
        if not signs:
            return f"{one} *[^ {alone}]+| +"
        return f"{one} *[{signs}]*(?:[^ {alone}{signs}]+(?:(?<![{latin}])[{signs}]+)?)*"

    @staticmethod
    def _tree(pieces: dict[str, tuple[int, float]]) -> dict:
        ends, below = dict(pieces), {"": {}}
        for name in pieces:
            for k in range(1, len(name) + 1):
                below.setdefault(name[: k - 1], {})[name[k - 1]] = name[:k]
        made: dict[str, dict] = {}
        for prefix in sorted(below, key=len, reverse=True):
            made[prefix] = {c: (made.get(x), ends.get(x)) for c, x in below[prefix].items()}
        if "▁" in made[""]:
            for tree in made.values():
                if "▁" in tree:
                    tree[" "] = tree["▁"]
        return made[""]

    def _number(self, pieces: dict[str, tuple[int, float]]) -> None:
        """The tree again, in arrays: keys (node << 21 | character) in order, the node that each leads to, and for each node
        the id of its piece or -1."""
        nodes = {"": 0}
        for name in pieces:
            for k in range(1, len(name) + 1):
                nodes.setdefault(name[:k], len(nodes))
        self.piece, self.value = np.full(len(nodes), -1), np.zeros(len(self.bytes_of))
        for name, (i, score) in pieces.items():
            self.piece[nodes[name]], self.value[i] = i, score
        steps = []
        for name, k in nodes.items():
            if name:
                above = nodes[name[:-1]] << 21
                steps += [(above | ord(c), k) for c in ("▁ " if name[-1] == "▁" else name[-1])]
        steps.sort()
        self.keys, self.next = (np.array(x, np.int64) for x in zip(*steps, strict=True))

    def forget(self) -> None:
        #: Ids, score and least loss of each segment solved, and of those searched the n_best asked for: each one's loss, its
        #: ids and whether they decode to the segment; the first is the one solved.
        self.solved: dict[str, tuple[bytes, float, float]] = {}
        self.others: dict[tuple[str, int], list[tuple[float, bytes, bool]]] = {}
        self.held = 0

    def edges(self, s: str) -> list[tuple[int, int, int, float]]:
        """(from, to, id, score) by rising from; id -1 is a character that is no piece."""
        out, n = [], len(s)
        for i in range(n):
            tree, single = self.tree, False
            for j in range(i, n):
                got = tree.get(s[j])
                if got is None:
                    break
                tree, e = got
                if e is not None:
                    out.append((i, j + 1, e[0], e[1]))
                    single |= j == i
                if tree is None:
                    break
            if not single:
                out.append((i, i + 1, -1, self.unknown_score))
        return out

    def spelled(self, s: str, path: list[tuple[int, int, int]]) -> list[int]:
        ids = []
        for i, j, k in path:
            if k >= 0:
                ids.append(k)
            else:
                got = [self.byte_ids[b] for b in s[i:j].replace("▁", " ").encode("utf-8", "surrogatepass")]
                ids.extend([self.unk] if None in got else got)
        return ids

    def solve(self, s: str) -> tuple[list[int], float, float]:
        """Ids and score of the best path, and the least loss of any other path: Viterbi with the two best scores a node."""
        n, root, low, unknown = len(s), self.tree, -np.inf, self.unknown_score
        best, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            x, y, tree, single = best[i], second[i], root, False
            j = i
            while j < n:
                got = tree.get(s[j])
                if got is None:
                    break
                j += 1
                tree, e = got
                if e is not None:
                    k, v = e
                    w = x + v
                    if w > best[j]:
                        if best[j] > second[j]:
                            second[j] = best[j]
                        best[j], back[j] = w, (i, j, k)
                    elif w > second[j]:
                        second[j] = w
                    if y + v > second[j]:
                        second[j] = y + v
                    if j == i + 1:
                        single = True
                if tree is None:
                    break
            if not single:
                j, w = i + 1, x + unknown
                if w > best[j]:
                    second[j] = max(second[j], best[j])
                    best[j], back[j] = w, (i, j, -1)
                else:
                    second[j] = max(second[j], w)
                second[j] = max(second[j], y + unknown)
        path, at = [], n
        while at:
            path.append(back[at])
            at = back[at][0]
        path.reverse()
        ids = [e[2] for e in path]
        if -1 in ids:
            ids = self.spelled(s, path)
        return ids, best[n], best[n] - second[n]

    def nbest(self, s: str, n_best: int) -> list[tuple[list[int], float]]:
        """(ids, score) of the n_best segmentations of a segment, best first, by A-star from its end.

        As the costs to go are exact, every entry of the agenda stands for a whole segmentation of its score: its own edges
        and the best path to them. An edge other than the best one into a node stands for a new one, and is left out if
        n_best are known that score no less."""
        n = len(s)
        into: list[list] = [[] for _ in range(n + 1)]
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for e in self.edges(s):
            into[e[1]].append(e)
            if best[e[0]] + e[3] > best[e[1]]:
                best[e[1]], back[e[1]] = best[e[0]] + e[3], e
        agenda, known, out, pushed = [(-best[n], n, 0, 0.0, None)], [best[n]], [], 0
        while agenda and len(out) < n_best:
            f, at, _, g, path = heapq.heappop(agenda)
            if not at:
                edges = []
                while path is not None:
                    e, path = path
                    edges.append(e[:3])
                out.append((self.spelled(s, edges), -f))
                continue
            for e in into[at]:
                value = best[e[0]] + e[3] + g
                if e is not back[at]:
                    if len(known) == n_best:
                        if value <= known[0]:
                            continue
                        heapq.heapreplace(known, value)
                    else:
                        heapq.heappush(known, value)
                else:
                    value = -f
                pushed += 1
                heapq.heappush(agenda, (-value, e[0], pushed, g + e[3], (e, path)))
        return out

    def solve_all(self, segments: list[str]) -> list[tuple[bytes, float, float]]:
        """What solve() finds for each segment, ids packed as little-endian u4: all segments step by step together.

        Segments lie in one flat array of characters, each with the sign APART after it. The tree is walked from all places at
        once, a character a step. Then nodes take their two best scores over the edges, by the place in the segment where
        an edge starts: edges of one such step never end in the same node."""
        if not segments:
            return []
        flat = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(x) for x in segments], np.int64)
        first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        place = np.arange(len(flat)) - np.repeat(first, size + 1)
        flat[first + size] = APART
        at = np.flatnonzero(flat != APART)
        node, starts, ends, ids = np.zeros(len(at), np.int64), [], [], []
        single = np.zeros(len(flat), bool)
        step = 0
        while len(at):
            key = node << 21 | flat[at + step]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[found] == key
            at, node = at[on], self.next[found[on]]
            step += 1
            piece = self.piece[node]
            here = piece >= 0
            starts.append(at[here]), ends.append(at[here] + step), ids.append(piece[here])
            if step == 1:
                single[at[here]] = True
        lone = np.flatnonzero((flat != APART) & ~single)
        start, end = np.concatenate([*starts, lone]), np.concatenate([*ends, lone + 1])
        piece = np.concatenate([*ids, np.full(len(lone), -1)])
        value = np.where(piece >= 0, self.value[piece], self.unknown_score)
        order = np.argsort(place[start], kind="stable")
        start, end, piece, value = start[order], end[order], piece[order], value[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(place[start])) + 1, [len(start)])).tolist()
        best, second, back = np.full(len(flat), -np.inf), np.full(len(flat), -np.inf), np.zeros(len(flat), np.int64)
        best[first] = 0.0
        for a, b in zip(cuts, cuts[1:], strict=False):
            x, y, v = start[a:b], end[a:b], value[a:b]
            old, new = best[y], best[x] + v
            second[y] = np.maximum(np.minimum(old, new), np.maximum(second[y], second[x] + v))
            better = new > old
            best[y[better]] = new[better]
            back[y[better]] = np.arange(a, b)[better]
        seg, at, count, steps = np.flatnonzero(size), (first + size)[size > 0], np.zeros(len(size), np.int64), []
        while len(seg):
            e = back[at]
            steps.append((seg, piece[e]))
            count[seg] += 1
            at = start[e]
            on = at > first[seg]
            seg, at = seg[on], at[on]
        offset = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(offset[-1], np.int64)
        for k, (seg, e) in enumerate(steps):
            out[offset[seg] + count[seg] - 1 - k] = e
        odd = {int(k) for k in np.searchsorted(offset, np.flatnonzero(out < 0), side="right") - 1}
        packed, ends = np.maximum(out, 0).astype("<u4").tobytes(), (4 * offset).tolist()
        with np.errstate(invalid="ignore"):
            top, loss = best[first + size].tolist(), (best[first + size] - second[first + size]).tolist()
        solved = []
        for k, x in enumerate(segments):
            ids = packed[ends[k] : ends[k + 1]]
            if k in odd:  # characters in byte pieces
                spelled, _, _ = self.solve(x)
                ids = struct.pack(f"<{len(spelled)}I", *spelled)
            solved.append((ids, top[k], loss[k]))
        return solved

    def learn(self, segments: set[str]) -> None:
        """Solves the segments that aren't yet."""
        if self.held > KEPT:  # short segments, which come back most, stay while they are few
            short = {x: v for x, v in self.solved.items() if len(x) <= SHORT}
            self.forget()
            size = sum(map(len, short)) + OVERHEAD * len(short)
            if 2 * size < KEPT:
                self.solved, self.held = short, size
        new, some, size = [x for x in segments if x not in self.solved], [], 0
        for x in [*new, None]:
            if some and (x is None or size + len(x) > SOLVED):
                self.solved.update(zip(some, self.solve_all(some), strict=True))
                self.held += size + OVERHEAD * len(some)
                some, size = [], 0
            if x is not None:
                some.append(x)
                size += len(x)

    def normalized(self, text: str) -> str:
        if self.plain:
            return " " * self.start + text
        return self.processor.normalize(text).replace("▁", " ")

    def cut(self, text: str) -> tuple[str, list[str]]:
        """A text as normalized, and its segments."""
        whole = self.normalized(text)
        segments = self.segments.findall(whole)
        if segments and not segments[-1]:
            segments.pop()
        return whole, segments

    def encode(self, text: str | None, n_best: int = N_BEST) -> tuple[bytes, list[float], list[int], str]:
        """(ids of the best segmentation as little-endian u4, scores and token counts of the n_best, normalized text)."""
        whole, segments = self.cut(text) if text else ("", [])
        self.learn(set(segments))
        found, scores, counts, _ = self.assembled(segments, n_best)
        return found[0], scores, counts, whole

    def alternatives(self, s: str, n_best: int) -> list[tuple[float, bytes, bool]]:
        """(loss, ids, decodes to the segment) of a solved segment's n_best segmentations, the solved one first of its ties."""
        if (s, n_best) not in self.others:
            own, plain = self.solved[s][0], s.replace("▁", " ").encode("utf-8", "surrogatepass")
            got = [(struct.pack(f"<{len(x)}I", *x), v) for x, v in self.nbest(s, n_best)]
            top, rest = got[0][1], [(x, v) for x, v in got if x != own]
            made = [(own, top), *rest[len(rest) + 1 - len(got) :]]  # of more ties than n_best the first gives way
            self.others[s, n_best] = [(top - v, x, self.spelt(np.frombuffer(x, "<u4")) == plain) for x, v in made]
            self.held += n_best * (len(s) + OVERHEAD)
        return self.others[s, n_best]

    def assembled(self, segments: list[str], n_best: int) -> tuple[list[bytes], list[float], list[int], bool]:
        """Ids, scores and token counts of the n_best combinations of solved segments, best first, and whether those of the
        segments that aren't at their best decode to them."""
        if not segments:
            return [b""], [0.0], [0], True
        packed, own, lost = zip(*map(self.solved.__getitem__, segments), strict=True)
        score, losses = sum(own), np.array(lost)
        few = np.argsort(losses, kind="stable")[: n_best - 1] if len(losses) <= 64 else self._least(losses, n_best - 1)
        few = few.tolist()
        options = [self.alternatives(segments[k], n_best) for k in few]
        found, scores, ok = [], [], True
        agenda = [(0.0, (0,) * len(options), 0)]
        while agenda and len(scores) < n_best:
            loss, choice, first = heapq.heappop(agenda)
            scores.append(score - loss)
            parts = list(packed)
            for k, c in enumerate(choice):
                if c:
                    parts[few[k]] = options[k][c][1]
                    ok = ok and options[k][c][2]
            found.append(b"".join(parts))
            for k in range(first, len(options)):
                c = choice[k]
                if c + 1 < len(options[k]):
                    heapq.heappush(agenda, (loss - options[k][c][0] + options[k][c + 1][0], choice[:k] + (c + 1,) + choice[k + 1 :], k))
        return found, scores, [len(x) // 4 for x in found], ok

    @staticmethod
    def _least(losses: np.ndarray, k: int) -> np.ndarray:
        """The first k in stable order of loss."""
        cut = np.partition(losses, k - 1)[k - 1] if k else -np.inf
        some = np.flatnonzero(losses <= cut)
        return some[np.argsort(losses[some], kind="stable")][:k]

    def spelt(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids, without the space that the model puts first."""
        out = self.spelt(ids)
        return out[1:] if self.prefix and out[:1] == b" " else out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _lists(values: list[bytes]) -> pa.ListArray:
    at = np.cumsum([0, *(len(x) // 4 for x in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(values), "<i4")))


def _encoder(path: str, n_best: int, with_ids: bool, with_nbest: bool):
    def run(batches):
        model = load(path)
        for batch in batches:
            for start, texts in slices(batch.column(1), CHARACTERS // n_best if with_nbest else CHARACTERS):
                n_bytes, n_tokens, crc, scores, counts, ok, ids, nbest, crcs = [], [], [], [], [], [], [], [], []
                cut = [model.cut(text) if text else ("", []) for text in texts]
                model.learn(set().union(*(segments for _, segments in cut)))
                for text, (whole, segments) in zip(texts, cut, strict=True):
                    found, s, c, others = model.assembled(segments, n_best)
                    got = found[0]
                    n_bytes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                    crcs.append(list(map(zlib.crc32, found)))
                    n_tokens.append(len(got) // 4), crc.append(crcs[-1][0]), scores.append(s), counts.append(c)
                    ok.append(others and model.decode(np.frombuffer(got, "<u4")) == whole[model.start :].replace("▁", " ").encode("utf-8", "surrogatepass"))
                    if with_ids:
                        ids.append(got)
                    if with_nbest:
                        nbest.append(found)
                columns = [batch.column(0).slice(start, len(texts)), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(crc, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(ok, pa.bool_())]
                names = ["rest", "n_bytes", "n_tokens", "ids_crc32", "nbest_scores", "nbest_tokens", "nbest_crc32", "round_trip"]
                if with_ids:
                    columns.append(_lists(ids))
                    names.append("ids")
                if with_nbest:
                    at = np.cumsum([0, *map(len, nbest)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), _lists([x for found in nbest for x in found])))
                    names.append("nbest_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model_path: str, n_best: int = N_BEST, with_ids: bool = False, text: str = "text", with_nbest: bool = False) -> DataFrame:
    """One row per document: its columns but the text, n_bytes, n_tokens and ids_crc32 of the best segmentation (crc32 of
    its ids as little-endian unsigned 32-bit integers), nbest_scores, nbest_tokens and nbest_crc32 of the n_best
    segmentations, best first, round_trip (the ids of each of them decode to the text), with_ids the best one's ids and
    with_nbest those of all, nbest_ids. Pieces decode one by one, so of the others only the segments that differ from the best
    one are decoded again. A map over the rows: no shuffle. model_path must be readable on every executor."""
    if n_best < 1:
        raise ValueError("n_best must be at least 1")
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(text).alias("text"))
    schema = T.StructType().add("rest", rows.schema["rest"].dataType).add("n_bytes", "long").add("n_tokens", "long").add("ids_crc32", "long")
    schema = schema.add("nbest_scores", T.ArrayType(T.DoubleType())).add("nbest_tokens", T.ArrayType(T.LongType())).add("nbest_crc32", T.ArrayType(T.LongType())).add("round_trip", "boolean")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if with_nbest:
        schema = schema.add("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType())))
    out = rows.mapInArrow(_encoder(model_path, n_best, with_ids, with_nbest), schema)
    made = [c for c in schema.names if c != "rest"]
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in others if c not in made), *made)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their ids in place of them, null for null; bytes that are no UTF-8 become U+FFFD."""
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (ids, text)]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))

    def run(batches):
        model = load(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["rest", "text"])

    out = rows.mapInArrow(run, T.StructType().add("rest", rows.schema["rest"].dataType).add("text", "string"))
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in others), F.col("text").alias(text))
