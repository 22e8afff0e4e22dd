"""Token ids in binary shards of patched frame-of-reference blocks.

Documents are encoded, dealt to parts by ranges of their order (doc_id, then a hash of the text, then their place in the
input) and written in that order, a part in one task that closes a shard whenever it holds SHARD_TOKENS ids. So a task holds
one shard at a time, however long the texts and however many rows share a doc_id, which ranges can split. A shard holds its
ids in blocks of 512. Of each block the least id is subtracted and the differences are packed at the width that 95 % of them need;
the high bits of the wider ones go to an exception list with their places. An index holds each block's start, minimum, width
and first exception, so any block can be read alone.

Shard layout, all little-endian: magic `MRPFOR01`; u64 ids, documents, blocks, exceptions, packed words; then the arrays
doc_id i64, null-id flags u8, lengths u32 (per document); start u64 (in words), minimum u32, width u8, first exception u64
(per block); the packed words u64; exception places u16 and high bits u32.

Defined results: null and empty texts have only the end id; null doc_ids come first; rows that share a doc_id follow each
other, in the order of a hash of their texts, equal rows in any order. A text of any length is in one shard. Columns other
than doc_id and the text play no part. An empty table gives no shards. A shard is written under a name of its own and moved
to its final name, so that a task that is run again replaces it by the same bytes.
"""

from __future__ import annotations

import array
import bisect
import functools
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialize, partitions_for, prefix_sums, scratch_path, slices, small_or_whole
from .token_counts import byte_letters

BLOCK = 512
PERCENTILE = 95
#: Documents of a part on average, and ids at which a shard is closed.
PART_DOCUMENTS = 20_000
SHARD_TOKENS = 4_000_000
#: Words that a worker keeps, and bytes of texts that are worked on at once.
KEPT = 400_000
SHORT = 6
CHARACTERS = 4_000_000
_MAGIC = b"MRPFOR01"
#: Stands for a null doc_id in the order.
_NULL = -(2**63)


# --- the format


def _pack(d: np.ndarray, width: int) -> np.ndarray:
    """(m, BLOCK) numbers below 2**width to (m, BLOCK * width / 64) words: 64 numbers fill `width` words."""
    m = len(d)
    if not width:
        return np.zeros((m, 0), np.uint64)
    by = np.ascontiguousarray(d.reshape(-1, 64).T)
    out = np.zeros((width, by.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= by[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= by[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(m, -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    m = len(words)
    if not width:
        return np.zeros((m, BLOCK), np.uint64)
    by = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, by.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = by[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= by[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(m, BLOCK)


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard; ids holds all documents' ids in order."""
    n_blocks = -(-len(ids) // BLOCK)
    values = np.zeros(n_blocks * BLOCK, np.uint64)
    values[: len(ids)] = ids
    if n_blocks:
        values[len(ids) :] = values[(n_blocks - 1) * BLOCK]  # the last block's rest repeats one of its ids
    values = values.reshape(-1, BLOCK)
    low = values.min(1) if n_blocks else np.zeros(0, np.uint64)
    d = values - low[:, None]
    bits = np.frexp(d.astype(np.float64))[1].astype(np.uint8)
    k = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.partition(bits, k, axis=1)[:, k] if n_blocks else np.zeros(0, np.uint8)
    at, place = np.nonzero(bits > width[:, None])
    high = (d[at, place] >> width[at].astype(np.uint64)).astype(np.uint32)
    size = width.astype(np.int64) * (BLOCK // 64)
    start = np.concatenate(([0], np.cumsum(size)))
    words = np.zeros(start[-1], np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(d[rows] & np.uint64((1 << int(w)) - 1), int(w))
        words[(start[rows][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    first = np.searchsorted(at, np.arange(n_blocks)).astype(np.uint64)
    parts = [
        np.array([len(ids), len(doc_ids), n_blocks, len(at), len(words)], "<u8"),
        np.array([x or 0 for x in doc_ids], "<i8"),
        np.array([x is None for x in doc_ids], "u1"),
        np.asarray(lengths, "<u4"),
        start[:-1].astype("<u8"),
        low.astype("<u4"),
        width.astype("u1"),
        first.astype("<u8"),
        words.astype("<u8"),
        place.astype("<u2"),
        high.astype("<u4"),
    ]
    return _MAGIC + b"".join(x.tobytes() for x in parts)


class Shard:
    """A view of a shard's bytes."""

    def __init__(self, content: bytes):
        if content[:8] != _MAGIC:
            raise ValueError("not a shard")
        n_ids, n_docs, n_blocks, n_exceptions, n_words = (int(x) for x in np.frombuffer(content, "<u8", 5, 8))
        at = 48
        got = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", n_blocks), ("<u4", n_blocks), ("u1", n_blocks), ("<u8", n_blocks), ("<u8", n_words), ("<u2", n_exceptions), ("<u4", n_exceptions)):
            got.append(np.frombuffer(content, kind, n, at))
            at += got[-1].nbytes
        self.n_ids = n_ids
        self.doc_ids, self.null, self.lengths, self.start, self.low, self.width, self.first, self.words, self.place, self.high = got

    def blocks(self, a: int, b: int) -> np.ndarray:
        """Ids of blocks a to b - 1 (of the last block with its filling)."""
        width = self.width[a:b]
        d = np.empty((b - a, BLOCK), np.uint64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            n = int(w) * (BLOCK // 64)
            d[rows] = _unpack(self.words[self.start[a:b][rows].astype(np.int64)[:, None] + np.arange(n)], int(w))
        x = int(self.first[a]) if a < b else 0
        y = int(self.first[b]) if b < len(self.first) else len(self.place)
        if a < b and y > x:
            row = np.searchsorted(self.first[a:b], np.arange(x, y), side="right") - 1
            place = self.place[x:y].astype(np.int64)
            d[row, place] |= self.high[x:y].astype(np.uint64) << width[row].astype(np.uint64)
        return (d + self.low[a:b].astype(np.uint64)[:, None]).ravel().astype(np.uint32)

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids start to start + count - 1, reading only the blocks that hold them."""
        end = self.n_ids if count is None else min(self.n_ids, start + count)
        a, b = start // BLOCK, -(-end // BLOCK)
        return self.blocks(a, max(a, b))[start - a * BLOCK : end - a * BLOCK]


# --- encoding


class Encoder:
    """Ids of a tokenizers file's words, which a worker asks the library for once.

    Holds for vocabularies whose pre-tokens never cross ASCII white space, which is dropped, and whose normalizer lowers
    case: then the parts between it are encoded alone, and A-Z may be lowered first. Parts that may hold a special token
    are looked up as they stand. A part of plain Latin letters is one pre-token, for which the library's model is asked
    without its normalizer; ASCII signs after a letter, at the end, are pre-tokens of their own."""

    #: Signs that are pre-tokens of their own after a letter.
    SIGNS = ".,;:!?*#$%&|()\""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.latin = re.compile("[a-zà-öø-ÿ]+").fullmatch
        self.to_letters = dict(enumerate(map(ord, byte_letters())))
        probe = "Ab  cd\n\tEF,gh"
        if self._whole(probe) != [x for w in probe.lower().split() for x in self._whole(w)]:
            raise ValueError("this vocabulary's words depend on white space or case")
        self.words: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, x: str) -> bytes:
        if "<" in x:
            ids = self._whole(x)
        elif x.isascii() and x.isalpha() and x.islower():
            ids = [t.id for t in self.model.tokenize(x)]
        else:
            core = x.rstrip(self.SIGNS)
            if core != x and core[-1:].isalpha():
                words, tail = self.words, x[len(core) :]
                for y in (core, tail):
                    if y not in words:
                        words[y] = self._part(y)
                return words[core] + words[tail]
            if self.latin(x):
                ids = [t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.to_letters))]
            else:
                ids = self._whole(x)
        return array.array(self.code, ids).tobytes()

    def parts(self, distinct: list[str]) -> list[bytes]:
        """The packed ids of each of the parts; what isn't known yet is encoded."""
        if len(self.words) > KEPT:  # short words, which come back most, stay while they are few
            short = {x: v for x, v in self.words.items() if len(x) <= SHORT}
            self.words = short if 2 * len(short) < KEPT else {"": b""}
        words, out, tokenize, pack, code = self.words, [], self.model.tokenize, array.array, self.code
        for x in distinct:
            got = words.get(x)
            if got is None:
                if x.isalpha() and x.isascii() and x.islower():
                    got = pack(code, [t.id for t in tokenize(x)]).tobytes()
                else:
                    got = self._part(x)
                words[x] = got
            out.append(got)
        return out

    def encode(self, texts: list[str | None], end_id: int) -> pa.Array:
        """The ids of each text (null: empty) and the end id, as binary. Words are told apart by Arrow and looked up once
        for all texts; their ids are then laid out by numpy."""
        texts = pa.array([x or "" for x in texts], pa.large_string())
        special = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        held = self.parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(held), self.kind)
        size = np.array([len(x) for x in held], np.int64) // self.kind.itemsize
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        # the words of all texts in a row, with the end id as one more after each text
        n = pc.list_value_length(words).to_numpy()
        ends = np.cumsum(n)
        size, first = np.append(size, 1), np.append(first, len(flat))
        row = np.insert(at, ends, len(size) - 1)
        long_ = size[row]
        place = np.repeat(first[row] - (np.cumsum(long_) - long_), long_) + np.arange(long_.sum())
        ids = np.append(flat, np.array([end_id], self.kind))[place]
        bounds = np.concatenate(([0], np.cumsum(long_)[ends + np.arange(len(ends))])) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.tobytes())])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def parts_of(ids: np.ndarray, h: np.ndarray, uid: np.ndarray, bounds: list[tuple[int, int, int]]) -> np.ndarray:
    """The number of bounds at or below each row's (id, h, uid)."""
    first = np.array([b[0] for b in bounds], np.int64)
    low, high = (np.searchsorted(first, ids, side=side) for side in ("left", "right"))
    for i in np.flatnonzero(low != high):
        low[i] = bisect.bisect_right(bounds, (int(ids[i]), int(h[i]), int(uid[i])), int(low[i]), int(high[i]))
    return low.astype(np.int32)


def _encoder(path: str, end_id: int, bounds: list[tuple[int, int, int]]):
    """(doc_id, h, uid, text) to (part, doc_id, h, uid, ids)."""

    def run(batches):
        encoder = load(path)
        for batch in batches:
            ids = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
            part = parts_of(ids, batch.column(1).to_numpy(), batch.column(2).to_numpy(), bounds)
            for a, texts in slices(batch.column(3), CHARACTERS):
                got = encoder.encode(texts, end_id).cast(pa.binary())
                columns = [pa.array(part[a : a + len(got)]), *(batch.column(k).slice(a, len(got)) for k in range(3)), got]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "h", "uid", "ids"])

    return run


# --- shards in Spark


def put(uri: str, name: str, content: bytes) -> None:
    """Writes a file through Arrow's file systems, under its final name only when complete."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    held = f"{path}/.{uuid.uuid4().hex}"
    with system.open_output_stream(held) as f:
        f.write(content)
    system.move(held, f"{path}/{name}")


def _writer(uri: str, kind: str):
    def run(batches):
        """Rows sorted by part and order to (part, shard, n_ids); one shard is held in memory at a time."""
        docs, ids, held, part, shard = [], [], 0, None, 0

        def done():
            flat = np.frombuffer(b"".join(ids), kind)
            length = np.array([len(x) for x in ids], np.int64) // np.dtype(kind).itemsize
            put(uri, f"shard-{part:07d}-{shard:06d}.pfor", write_shard(docs, length, flat))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(flat)], pa.int64())], ["part", "shard", "n_ids"])

        for batch in batches:
            for start, some in slices(batch.column(2), CHARACTERS):
                parts, own = (batch.column(k).slice(start, len(some)).to_pylist() for k in (0, 1))
                for p, i, x in zip(parts, own, some, strict=True):
                    if docs and (p != part or held >= SHARD_TOKENS):
                        yield done()
                        docs, ids, held, shard = [], [], 0, shard + 1 if p == part else 0
                    part = p
                    docs.append(i), ids.append(x)
                    held += len(x) // np.dtype(kind).itemsize
        if docs:
            yield done()

    return run


def write_token_ids(docs: DataFrame, vocabulary_path: str, uri: str, end_id: int = 1, text: str = "text") -> DataFrame:
    """Writes the shards below uri and returns a table of them: part, shard, n_ids, n_ids_before. Documents are encoded
    once; only their ids are shuffled. The ranges of the parts come from a range partitioning of the narrow keys; one bound
    for some PART_DOCUMENTS documents goes to the tasks."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    n = partitions_for(spark, docs.count(), PART_DOCUMENTS)
    keys = rows.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), "h", "uid").repartitionByRange(n, "doc_id", "h", "uid")
    first = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "h", "uid")).alias("first"))
    bounds = sorted((r[0], r[1], r[2]) for r in first.select("first.*").collect())[1:]
    encoded = rows.mapInArrow(_encoder(vocabulary_path, end_id, bounds), "part int, doc_id long, h long, uid long, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "h", "uid")
    kind = load(vocabulary_path).kind.str
    written = dealt.select("part", "doc_id", "ids").mapInArrow(_writer(uri, kind), "part int, shard int, n_ids long")
    return prefix_sums(materialize(written, "shards"), ["part", "shard"], ["n_ids"])


def _reader(batches):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(content.as_buffer().to_pybytes())
            ids = shard.ids().astype("<u4", copy=False)
            ends = np.cumsum(shard.lengths, dtype=np.int64)
            starts = ends - shard.lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            part, number = map(int, name.rsplit("shard-", 1)[1].split(".")[0].split("-"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(crc), part, np.int32)), pa.array(np.full(len(crc), number, np.int32)), pa.array(shard.doc_ids, mask=shard.null.astype(bool)), pa.array(starts), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_ids(spark: SparkSession, uri: str, shards: DataFrame) -> DataFrame:
    """One row per document from the shards below uri: doc_id, start (ids of all documents before it), n_tokens, and
    ids_crc32, the crc32 of its ids as little-endian unsigned 32-bit integers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(uri).select("path", "content")
    docs = files.mapInArrow(_reader, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = small_or_whole(shards.select("part", "shard", "n_ids_before"))  # one row per shard
    return docs.join(before, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("n_ids_before")).alias("start"), "n_tokens", "ids_crc32")


def token_id_round_trip(docs: DataFrame, vocabulary_path: str, end_id: int = 1) -> DataFrame:
    """Writes all documents' ids to the shared folder and reads them back."""
    spark = docs.sparkSession
    uri = scratch_path(spark, "token-ids")
    shards = write_token_ids(docs, vocabulary_path, uri, end_id)
    spark._jvm.org.apache.hadoop.fs.Path(uri).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(uri))
    return read_token_ids(spark, uri, shards)
