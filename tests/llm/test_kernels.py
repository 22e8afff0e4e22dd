"""The Python kernels of the operators against the libraries, brute force and exact round trips. No Spark here."""

import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import sentencepiece_nbest, token_counts, token_output

TEXTS = [
    "", " ", "a", "Hello  world", " lead and trail ", "it's they'll 's 're x'd", "naïve café — ÉCOLE 东京 ☃", "tabs\tand\nlines\r\n  two", "aaaaaaaaaaaa bbbbbbb aaaa",
    "<|endoftext|>x<|startoftext|> y <|ENDOFTEXT|>", "x <|endoftext|> y", "12345 678,90 #*$%&|<>", "a b c\u001cd", "é İ ﬁ ª", "word," * 50, "👍🏽 ok", "!!! ??? ...", "don't. stop", "trail  ", "\n\n a\n b",
]
words = st.text(st.sampled_from("abé' ,.\n\t  <|>9A東"), max_size=40)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_nbest.Model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def unigram():
    """The library on the same pieces, told that they are a unigram model: it then has the same lattice."""
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(fields):
        return b"".join(varint(k << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for k, v in fields)

    top = sentencepiece_nbest.proto_fields(data)
    patched = b""
    for k, v in top:
        if k == 2:
            # the trainer's settings that matter: kind 1 is unigram; field 35 is the byte fallback
            v = message([(3, 1), (35, 1)])
        patched += message([(k, v)])
    return sentencepiece.SentencePieceProcessor(model_proto=patched)


def every(model, s):
    """All segmentations of a short segment with their scores."""
    edges = model.edges(s)

    def walk(i):
        if i == len(s):
            yield 0.0, []
        for e in edges:
            if e[0] == i:
                for score, path in walk(e[1]):
                    yield score + e[3], [e[:3], *path]

    return sorted(((score, model.spelled(s, path)) for score, path in walk(0)), key=lambda x: -x[0])


@pytest.mark.parametrize("s", ["▁hello", "▁on", "▁thinnted", "▁▁▁a", "x", "éèx東", "☃☃", "▁ab☃c"])
def test_nbest_equals_enumeration(model, s):
    brute = every(model, s)
    got = model.nbest(s, 6)
    assert [v for _, v in got] == pytest.approx([v for v, _ in brute[:6]])
    assert all(any(v == pytest.approx(score) and ids == path for v, path in brute) for ids, score in got)
    ids, best, loss = model.solve(s)
    assert best == pytest.approx(brute[0][0])
    assert loss == (pytest.approx(brute[0][0] - brute[1][0]) if len(brute) > 1 else np.inf)


@pytest.mark.parametrize("text", ["hello world", "on an it", "ab cd", "a  b", "thinn ted é"])
def test_text_nbest_equals_enumeration(model, text):
    whole = "▁" + text.replace(" ", "▁")
    brute = every(model, whole)[:4]
    ids, scores, counts, _ = model.encode(text, 4)
    assert scores == pytest.approx([v for v, _ in brute])
    if brute[0][0] > brute[1][0]:
        assert np.frombuffer(ids, "<u4").tolist() == brute[0][1]
    assert counts[0] == len(ids) // 4 and len(counts) == len(brute)


def test_nbest_equals_library_on_the_same_pieces(model, unigram):
    for text in ["Hello world, this is a test of the lattice.", "Ascirr para osóciónta cióngañ no.", "x y z", "Anblewh sttible athawh thonre"]:
        ids, scores, _, _ = model.encode(text, 4)
        mine = np.frombuffer(ids, "<u4").tolist()
        score = lambda got: sum(unigram.get_score(i) for i in got)
        assert score(mine) == pytest.approx(scores[0])
        best = sorted((score(x) for x in unigram.nbest_encode_as_ids(text, 4)), reverse=True)
        assert scores == pytest.approx(best)


@settings(max_examples=200, deadline=None)
@given(words)
def test_sentencepiece_round_trip(text):
    m = sentencepiece_nbest.load(public_tokenizers.path("piece_bpe_32k.model"))
    ids = np.frombuffer(m.encode(text, 3)[0], "<u4")
    assert m.decode(ids).decode() == text
    assert m.processor.decode([int(i) for i in ids]) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abénthi東▁ ,9☃"), min_size=1, max_size=30), max_size=12))
def test_segments_solved_together_equal_one_by_one(segments):
    import struct

    m = sentencepiece_nbest.load(public_tokenizers.path("piece_bpe_32k.model"))
    for x, (packed, score, loss) in zip(segments, m.solve_all(segments), strict=True):
        ids, best, least = m.solve(x)
        assert score == pytest.approx(best) and loss == (pytest.approx(least) if np.isfinite(least) else np.inf)
        assert packed == struct.pack(f"<{len(ids)}I", *ids)


def test_long_unbroken_texts_take_linear_memory(model):
    import random
    import tracemalloc

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(200_000))
    tracemalloc.start()
    segment = "▁" + text
    got = model.nbest(segment, 4)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert got[0][1] == pytest.approx(model.solve(segment)[1]) and len({tuple(x) for x, _ in got}) == 4
    assert [v for _, v in got] == sorted((v for _, v in got), reverse=True)


def counts(texts):
    return token_counts.load(public_tokenizers.path("byte_bpe_50k.json")).counts(texts)


def library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_library():
    assert counts(TEXTS) == [len(x) for x in library("byte_bpe_50k.json", TEXTS)]


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=5))
def test_token_counts_equal_library_on_random_texts(texts):
    assert counts(texts) == [len(x) for x in library("byte_bpe_50k.json", texts)]


def encoded(texts):
    e = token_output.load(public_tokenizers.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts, 1).to_pylist()]
    assert all(x[-1] == 1 for x in got)
    return [x[:-1] for x in got]


def test_word_ids_equal_library():
    assert encoded(TEXTS) == library("word_bpe_49k.json", TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5))
def test_word_ids_equal_library_on_random_texts(texts):
    assert encoded(texts) == library("word_bpe_49k.json", texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 2**62)), st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=900)), max_size=6), st.data())
def test_shard_round_trip(docs, data):
    ids = np.array(list(itertools.chain.from_iterable(x for _, x in docs)), np.uint32)
    shard = token_output.Shard(token_output.write_shard([d for d, _ in docs], np.array([len(x) for _, x in docs], np.int64), ids))
    assert shard.ids().tolist() == ids.tolist()
    assert shard.lengths.tolist() == [len(x) for _, x in docs]
    assert [None if z else int(d) for d, z in zip(shard.doc_ids, shard.null, strict=True)] == [d for d, _ in docs]
    a = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - a))
    assert shard.ids(a, n).tolist() == ids[a : a + n].tolist()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_output.Shard(b"something else" * 10)
    with pytest.raises(ValueError):
        token_counts.Merges(public_tokenizers.path("word_bpe_49k.json"))
