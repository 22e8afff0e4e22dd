"""The operators in Spark against brute force, the libraries and held-out labels, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import collections
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import common, components, embedding_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, sentencepiece_nbest, substring_dedup, token_counts, token_output, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ["row", "rest", "size", "kept", "cid", "rep", "m", "n_words", "stratum", "gone", "key", "own", "copies", "evidence", "cut", "h", "n_tokens"]
WORDS = [a + b for a in "ka lo mi ne pu ra si to ve xo".split() for b in "n r st l m".split()]


def prose(rng, n):
    out = []
    while n > 0:
        k = min(n, rng.randint(4, 14))
        out.append(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "fr"]), f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    for i in range(40, 70):  # near copies: a few words changed
        w = base[i % 10].split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s0", 0))
    passage = prose(rng, 70)
    rows += [(70 + i, base[20 + i] + "\n" + passage + "\n" + prose(rng, 40), "en", "s1", 0) for i in range(4)]
    rows += [(80, None, None, None, None), (81, "", "en", "s1", 0), (82, "  \n\t ", "de", "s2", 3), (83, "one two", "en", "s2", 7), (84, "one two", "en", "s2", 7), (85, "One TWO", "en", None, 7)]
    rows += [(None, base[0], "en", "s0", 1), (5, base[5], "en", "s1", 1), (5, base[5], "en", "s1", 1), (90, prose(rng, 30_000), "en", "s3", 1), (91, "word " * 3000, "en", "s3", 1), (92, "x" * 50_000, "en", "s3", 1), (93, "### $$$ " * 100, "fr", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASHES})


def multiset(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- 1


def test_sentencepiece(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sentencepiece_nbest.encode(clashing(docs), path, with_ids=True).collect()
    assert len(got) == len(corpus()) and all(r["round_trip"] and r["size"] == "mine" for r in got)
    model = sentencepiece_nbest.Model(path)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, *_ in corpus():
        r = by_id[i]
        ids = np.array(r["ids"], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["n_tokens"] == r["nbest_tokens"][0]
        assert model.processor.decode([int(x) for x in ids]) == (text or "")
        assert r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
    assert by_id[80]["nbest_scores"] == [0.0] and by_id[81]["n_tokens"] == 0
    assert sentencepiece_nbest.encode(empty, path).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_nbest.encode(docs, path, n_best=0)


# --- 2


def vectors():
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for label in (1, 2, None):
        for center in rng.standard_normal((6, 16)):
            for _ in range(int(rng.integers(1, 30))):
                rows.append((at, (center + 0.06 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                at += 1
    rows += [(at, rows[0][1], 1), (at + 1, [2 * x for x in rows[0][1]], 1), (at + 2, None, 1), (at + 3, [0.0] * 16, 1), (at + 4, [1.0, None] * 8, 1), (at + 5, [float("nan")] * 16, 1), (at + 6, [float("inf")] + [1.0] * 15, 1), (at + 7, [], 1), (at + 8, [1.0, 0.0], 1), (at + 9, [1.0, 0.01], 1), (None, rows[1][1], 1)]
    return rows


def test_embedding_dedup(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)

    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and a[2] is not None and a[2] == b[2] and ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i].add(j)
    want = collections.Counter()
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else None
        want[(rows[i][0], len(links[i]), comp, rows[i][0] == comp)] += 1
    assert multiset(embedding_dedup.embedding_links(df), "vec_id", "n_links", "component_id", "kept") == want
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)  # windows of several blocks
    monkeypatch.setattr(embedding_dedup, "WINDOW", 5)
    assert multiset(embedding_dedup.embedding_links(df), "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup.embedding_links(df.where("false")).count() == 0


def test_close_pairs_of_one_crowded_label_are_all_found(spark):
    rng = np.random.default_rng(2)
    n, planted = 9_000, 400
    center = rng.standard_normal(64)
    # all pairs at cosines of about 0.95; planted ones at about 0.982
    x = center / np.linalg.norm(center) + rng.standard_normal((n, 64)) / 35
    far = math.sqrt(0.018 * 2 * (1 + 64 / 1225)) / 8
    x[n - planted :] = x[:planted] + far * rng.standard_normal((planted, 64))
    x = x[rng.permutation(n)].astype(np.float32)
    df = spark.createDataFrame(list(zip(range(n), x.tolist(), [1] * n, strict=True)), "vec_id long, embedding array<float>, label int").repartition(4)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    assert len(a) >= planted / 2
    want = collections.Counter(np.concatenate([a, b]).tolist())
    comp = list(range(n))
    for _ in range(20):
        for i, j in zip(a, b, strict=True):
            comp[i] = comp[j] = min(comp[i], comp[j])
    got = embedding_dedup.embedding_links(df).collect()
    assert {r["vec_id"]: r["n_links"] for r in got if r["n_links"]} == want
    assert {r["vec_id"]: r["component_id"] for r in got} == dict(enumerate(comp))


@pytest.mark.parametrize("mutual", [0.7, 0.94])
def test_passes_find_the_links_of_large_labels(spark, mutual):
    """Recall of the passes against brute force, for labels spread out and concentrated, at 8 and at 300 partitions."""
    rng = np.random.default_rng(3)
    n, planted, dim = 30_000, 1_000, 64
    x = rng.standard_normal((n, dim)) / math.sqrt(dim)
    x = math.sqrt(mutual) * np.eye(dim)[0] + math.sqrt(1 - mutual) * x
    for k, cosine in enumerate((0.981, 0.985, 0.99)):
        a, b = slice(k * planted, (k + 1) * planted), slice(n - (k + 1) * planted, n - k * planted)
        x[b] = x[a] + math.sqrt(2 - 2 * cosine) / math.sqrt(dim) * rng.standard_normal((planted, dim))
    x = x[rng.permutation(n)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.concatenate([(u[s : s + 2000] @ u.T >= 0.98).sum(1) - 1 for s in range(0, n, 2000)])
    got = []
    for parts in (8, 300):
        out = embedding_dedup.embedding_links(df.repartition(parts)).collect()
        got.append(dict((r["vec_id"], r["n_links"]) for r in out))
    assert got[0] == got[1]
    found = np.array([got[0][i] for i in range(n)])
    assert (found <= want).all() and want.sum() >= 2 * 2.5 * planted and found.sum() >= 0.995 * want.sum()
    read = df.select("vec_id", "label", "embedding").mapInArrow(embedding_dedup._read, "vec_id long, label int, dim int, v binary")
    codes = embedding_dedup.coded(read.select(F.lit(1).cast("long").alias("grp"), "dim", "v", F.col("vec_id").alias("cid")))
    passes = codes.select(F.max(F.size("codes"))).first()[0]
    print(f"mutual cosine {mutual}: {passes} passes, {found.sum()} of {want.sum()} links")
    assert passes > 1 or mutual >= 0.9  # the most concentrated are compared completely


def test_blocks_are_joined_over_windows(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "WINDOW", 3)
    rng = np.random.default_rng(4)
    for own in (True, False) * 30:
        m = rng.standard_normal((40, 3))
        side, weight = np.arange(40) >= (40 if own else 17), rng.integers(1, 4, 40)
        u = m / np.linalg.norm(m, axis=1)[:, None]
        link = (u @ u.T >= 0.95) & ~np.eye(40, dtype=bool) & (own | (side[:, None] != side[None, :]))
        count, root = embedding_dedup.compared(side.astype(int), weight, m, 0.95)
        reach = np.linalg.matrix_power((link | np.eye(40, dtype=bool)).astype(float), 40) > 0
        assert (count == link @ weight).all() and (root == reach.argmax(1)).all()


# --- 3 and 6


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text, *_ in corpus():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want[(i, len((text or "").encode()), n, n > 1024)] += 1
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert multiset(token_counts.token_counts(clashing(docs), path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_output(docs, empty, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(((i, np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")) for i, text, *_ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = collections.Counter(), 0
    for i, ids in rows:
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert multiset(token_output.token_id_round_trip(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == want
    monkeypatch.setattr(token_output, "PART_DOCUMENTS", 9)
    monkeypatch.setattr(token_output, "SHARD_TOKENS", 500)
    assert multiset(token_output.token_id_round_trip(clashing(docs), path), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_output.token_id_round_trip(empty, path).count() == 0


def test_shards_of_one_doc_id_and_of_long_texts(spark, monkeypatch, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    rows = [(7, prose(rng, 6)) for _ in range(60)] + [(7, "the same words")] * 20_000 + [(None, "x"), (8, "abc " * 250_000), (9, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(token_output, "PART_DOCUMENTS", 2_000)
    monkeypatch.setattr(token_output, "SHARD_TOKENS", 3_000)
    uri = f"file://{tmp_path}/ids"
    shards = token_output.write_token_ids(df, path, uri)
    sizes = [r["n_ids"] for r in shards.collect()]
    parts = collections.Counter(r["part"] for r in shards.collect())
    assert len(parts) > 6 and len(sizes) > 25 and sorted(sizes)[-2] < 3_000 + 200  # all but the long text's
    got = token_output.read_token_ids(spark, uri, shards).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: -1 if x is None else x) and at == sum(sizes)


def test_parts_follow_the_order_of_keys():
    import bisect

    rng = random.Random(5)
    keys = sorted((rng.randint(0, 4), rng.randint(-2, 2), rng.randint(0, 9)) for _ in range(300))
    bounds = sorted(rng.sample(keys, 12))
    got = token_output.parts_of(*(np.array(x, np.int64) for x in zip(*keys, strict=True)), bounds)
    assert got.tolist() == [bisect.bisect_right(bounds, k) for k in keys]


# --- 4


def pages():
    link = lambda *hosts: "".join(f'<a href="{h}">x</a>' for h in hosts)
    return [
        (1, "http://a.org/x", link("http://b.net/1", "//c.net", "/own", "HTTPS://B.NET/2")), (2, "https://b.net/y?q=1", link("https://c.net/", "http://bad.com/de/1")), (3, "http://c.net", link()),
        (4, "http://bad.com/de/x#f", link("http://b.net")), (5, "http://bad.com/de", link("http://near.net")), (6, "http://near.net/p", link("http://bad.com/de/", "http://bad.com/de/2")), (7, "http://X.Example.ORG/es/1", None),
        (8, "http://example.org/en/12", ""), (9, "http://example.org/en/2", ""), (10, None, ""), (11, "no scheme", ""), (12, "http://notorg/", ""), (13, "http://com/fr/", ""), (14, "http://x.com/fr", ""), (15, "ftp://a://b/c", ""), (15, "ftp://a://b/c", ""), (16, "", None), (17, "http://org/", ""), (18, "http://bad.com/de/z", link("http://near.net")),
    ]


def judged_by_hand(rows):
    import re

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fits = [(len(r), v, r) for v, r in url_filters.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return max(fits)[1:] if fits else (None, None)

    at = [(i, *split(u), html) for i, u, html in rows]
    under = collections.defaultdict(lambda: [0, 0])
    for _, h, p, _ in at:
        v, _ = rule(h, p)
        if h and v:
            under[h][v == "block"] += 1
    weight = collections.Counter()
    for _, h, _, html in at:
        for x in re.findall(r'(?i)href="(?:https?:)?//([^/?#"]+)', html or ""):
            if h and h != x.lower():
                weight[h, x.lower()] += 1

    def flow(edges, seeds):
        total = collections.Counter()
        for (a, _), w in edges.items():
            total[a] += w
        restart = {h: s * 0.15 for h, s in seeds.items() if s}
        now = {h: s for h, s in seeds.items() if s}
        for _ in range(url_filters.STEPS):
            new = collections.Counter(restart)
            for (a, b), w in edges.items():
                new[b] += 0.85 * now.get(a, 0) * w / total[a]
            now = new
        return now

    trust = flow(weight, {h: a / (a + b) for h, (a, b) in under.items()})
    distrust = flow({(b, a): w for (a, b), w in weight.items()}, {h: b / (a + b) for h, (a, b) in under.items()})
    out = collections.Counter()
    for i, h, p, _ in at:
        v, r = rule(h, p)
        out[(i, h, p, r, v or ("block" if distrust.get(h, 0) - trust.get(h, 0) > url_filters.THRESHOLD else "allow"))] += 1
    return out


def test_url_filters(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    columns = ("page_id", "host", "path", "rule", "verdict")
    want = judged_by_hand(pages())
    assert (6, "near.net", "/p", None, "block") in want and (2, "b.net", "/y", None, "allow") in want
    assert multiset(url_filters.url_verdicts(df.withColumn("trust", F.lit(1))), *columns) == want
    plain = [(i, u, None) for i, u, _ in pages()]
    assert multiset(url_filters.url_verdicts(spark.createDataFrame(plain, df.schema)), *columns) == judged_by_hand(plain)
    assert url_filters.url_verdicts(df.where("false")).count() == 0


@pytest.mark.parametrize("linkers", [1, 2, 100])
def test_distrust_does_not_shrink_with_the_number_of_linkers(spark, linkers):
    rows = [(0, "http://bad.com/de/1", None)]
    rows += [(i, f"http://farm{i}.net/", '<a href="http://bad.com/de/1">x</a>') for i in range(1, linkers + 1)]
    rows += [(1000 + i, f"http://mixed{i}.net/", '<a href="http://bad.com/de/1">x</a><a href="http://fine.net/">x</a>') for i in range(linkers)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filters.url_verdicts(df).collect()}
    assert all(got[i]["verdict"] == "block" and got[i]["distrust"] == pytest.approx(0.1275) for i in range(1, linkers + 1))
    assert all(got[1000 + i]["verdict"] == "allow" for i in range(linkers))


# --- 5


def spans_by_hand(text):
    """First word and words of every span: window by window, on the words themselves."""
    import xxhash

    size, span, words = 8, 43, text.lower().split()
    order = [(w[-1] not in ".!?", xxhash.xxh3_64_intdigest(w) >> 1) for w in words]
    starts = {0}
    for a in range(len(words) - size + 1):
        window = order[a : a + size]
        starts.add(a + max(i for i in range(size) if window[i] == min(window)) + 1)
    return {a: tuple(words[a : a + span]) for a in sorted(starts) if a + span <= len(words)}


def cut_by_hand(rows):
    import re

    places = collections.defaultdict(list)
    for i, text in {(r[0], r[1]) for r in rows if r[1]}:
        for at, words in spans_by_hand(text).items():
            places[words].append(((i is not None, i or 0), at, i, text))
    drop = collections.defaultdict(set)
    for words, found in places.items():
        for _, at, i, text in sorted(found)[1:]:
            drop[i, text].update(range(at, at + len(words)))
    kept = lambda i, t: None if t is None else "".join(x for k, x in enumerate(re.findall(r"^\s+|\S+\s*", t), -int(t[:1].isspace())) if k not in drop[i, t])
    return collections.Counter((r[0], kept(r[0], r[1])) for r in rows)


def test_substring_dedup(docs, empty):
    want = cut_by_hand(corpus())
    assert multiset(substring_dedup.remove_repeats(docs), "doc_id", "text") == want
    report = substring_dedup.repeat_report(clashing(docs)).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in report) == want
    by_id = {r["doc_id"]: r for r in report}
    passage = corpus()[70][1].split("\n")[1]
    assert passage in by_id[70]["text"] and passage.split()[30] not in by_id[71]["text"].split("\n")[-1].split()[:20]
    assert all(by_id[i]["removed_words"] >= 70 - 15 for i in (71, 72, 73))  # the passage stays in its first document
    assert all(r["changed"] == (r["n_removed"] > 0) == (r["removed_words"] > 0) for r in report)
    assert by_id[90]["n_removed"] == 0 and by_id[80]["text"] is None and by_id[81]["text"] == ""
    assert substring_dedup.remove_repeats(clashing(docs)).columns == clashing(docs).columns
    assert substring_dedup.remove_repeats(clashing(docs)).where("gone = 'mine' and key = 'mine'").count() == len(corpus())
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("stops", [True, False])
def test_every_passage_of_51_words_is_found(stops):
    rng = random.Random(11)
    plain = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    words = lambda n: prose(rng, n + 14).split()[:n] if stops else plain(n)
    for trial in range(400):
        n = rng.choice([51, 51, 52, 60, 90])
        passage = words(n)
        texts = [gap.join(words(rng.randint(0, 30)) + passage + words(rng.randint(0, 30))) for gap in (" ", "\t\n" if trial % 2 else " ")]
        first = {h for _, h in substring_dedup.spans(texts[0])}
        gone = [a for a, h in substring_dedup.spans(texts[1]) if h in first]
        cut, stretches, removed = substring_dedup.without(texts[1], gone)
        assert stretches == 1 and removed >= n - 15 and len(cut.split()) == len(texts[1].split()) - removed


def test_short_common_passages_stay():
    rng = random.Random(12)
    words = lambda n: prose(rng, n + 14).split()[:n]
    for n in (16, 30, 42):
        passage = words(n)
        texts = [" ".join(words(60) + passage + words(60)) for _ in range(2)]
        assert not {h for _, h in substring_dedup.spans(texts[0])} & {h for _, h in substring_dedup.spans(texts[1])}


def test_slices_hold_every_row():
    import pyarrow as pa

    texts = [None, "", "a" * 50, "é" * 200, "b", None, "c" * 10, ""]
    for size in (1, 20, 100, 10_000):
        got = list(common.slices(pa.array(texts), size))
        assert [x for _, xs in got for x in xs] == texts
        assert [at for at, _ in got] == np.cumsum([0] + [len(xs) for _, xs in got])[:-1].tolist()
    assert list(common.slices(pa.array([], pa.string()), 10)) == []


# --- 7


def measured_by_hand(text):
    import re

    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, empty):
    extra = [(100 + i, t, "en", "s", 0) for i, t in enumerate(["a b c a b c", "a a a a", "a b\na b\n\n \na b", "é東😀 #x |", "a b c d a b c e b c d", "x\u00a0y\u2003z \x0bq"])]
    df = docs.unionAll(spark.createDataFrame(extra, SCHEMA))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = multiset(quality_rules.quality_verdicts(clashing(df), labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = collections.Counter()
    for i, t, *_ in corpus() + extra:
        m = measured_by_hand(t)
        bad = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want[(i, *m, bad, not bad)] += 1
    assert got == want
    assert quality_rules.quality_verdicts(empty, labels).count() == 0


def test_safe_cutoffs_are_exact_binomial(spark):
    rng = random.Random(9)
    rows = []
    for i in range(4000):
        lang = rng.choice(["en", "en", "en", None])
        rows.append((i, lang, 100, 500, rng.choice([0] * 199 + [30]), 0, 0, 10))
    df = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    labels = [(r[0], 1 if r[4] == 0 or rng.random() < 0.5 else 0) for r in rows] + [(1, None), (None, 1), (2, 0)]
    got = {r["stratum"]: r for r in quality_rules.safe_cutoffs(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    good = {i for i, q in labels if q == 1}
    tests = sum(len(g) for _, g in quality_rules.RULES.values())
    for stratum in ("en", None):
        held = [r for r in rows if r[1] == stratum and r[0] in good]
        n, p = len(held), quality_rules.LIMIT / len(quality_rules.RULES)
        safe = []
        for cut in quality_rules.RULES["symbols"][1]:
            k = sum(r[4] / r[3] > cut for r in held)
            tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            if tail <= quality_rules.CONFIDENCE_LOSS / (2 * tests):
                safe.append(cut)
        assert (got[stratum]["cut_symbols"] if stratum in got else None) == (min(safe) if safe else None)
    assert got["en"]["cut_symbols"] is not None


def test_quality_filter_uses_cutoffs(spark):
    rng = random.Random(4)
    text = {True: lambda: prose(rng, 60), False: lambda: " ".join(w + "###" for w in prose(rng, 60).split())}
    rows = [(i, text[i % 5 > 0](), "en", "s", 0) for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(1500)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in quality_rules.keep_good(clashing(df), labels).select("doc_id").collect()}
    assert kept == {i for i in range(1500) if i % 5}
    assert quality_rules.keep_good(clashing(df), labels).columns == clashing(df).columns


# --- 8


def filled_by_hand(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped, out = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing(spark, docs, empty):
    got = mixing.mixture(clashing(docs)).collect()
    words = collections.Counter((r[0], len((r[1] or "").split())) for r in corpus())
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == words
    sizes, source = collections.Counter(), {}
    for r in corpus():
        sizes[r[3]] += len((r[1] or "").split())
        source.setdefault(len(sizes), r[3])
    target = filled_by_hand(sizes)
    by_size = {(sizes[s], round(target[s], 6)): s for s in sizes}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        s = by_size[r["source_size"], round(r["target"], 6)]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mixture(docs.repartition(3))
    assert multiset(again, "doc_id", "size", "target", "taken") == collections.Counter((r["doc_id"], r["size"], r["target"], r["taken"]) for r in got)
    assert mixing.mixture(empty).count() == 0
    only_null = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["target"], r["taken"]) for r in mixing.mixture(only_null).collect()} == {(0.0, 0)}


def test_water_fill_of_many_small_sources(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 37}", rng.randint(1, 20) * (40 if i % 37 == 3 else 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = filled_by_hand(sizes)
    got = mixing.mix(df).collect()
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 400 + 1 for s in want) and sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mixed_documents(docs):
    df = clashing(docs)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = collections.Counter()
    for r in mixing.mixture(docs).collect():
        want[r["doc_id"], r["size"]] += r["taken"]
    got = collections.Counter()
    for r in out.collect():
        n = len((r["text"] or "").split())
        got[r["doc_id"], n] += n
    assert +got == +want


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_are_mixed_as_decided(spark, parts):
    rows = [(7, "one two three four five", "en", "a", 0)] * 20 + [(None, "x y", "en", "b", 0)] * 33 + [(100 + i, "p q r", "en", "c", 0) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    taken = collections.Counter()
    for r in mixing.mixture(df).collect():
        taken[r["doc_id"]] += r["taken"]
    assert sorted({r["taken"] // r["size"] for r in mixing.mixture(df).where("doc_id = 7").collect()}) in ([0, 1], [1, 2], [2, 3])  # the remainder ends among equal rows
    got = collections.Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert got == +taken and mixing.CHUNK > 33
    mixing.CHUNK, was = 8, mixing.CHUNK
    assert mixing.mixture(df).count() == len(rows) and sum(r["taken"] for r in mixing.mixture(df).collect()) == sum(taken.values())
    mixing.CHUNK = was


# --- 9


def grouped_by_hand(rows, percent):
    import re

    def shingles(t):
        w = [x for x in re.split(r"[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = collections.defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g].append(r[0])
    comp = [(min(least[g]) if least[g] else None) if s else r[0] for g, r, s in zip(group, rows, sets, strict=True)]
    return collections.Counter((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, comp, strict=True))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, empty, percent):
    want = grouped_by_hand(corpus(), percent)
    assert multiset(minhash_dedup.near_duplicates(clashing(docs), percent), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_open_buckets_are_finished_exactly(spark, monkeypatch):
    """A chain whose ends are alike only through the middle, and a crowd just below the threshold, in small blocks."""
    rng = random.Random(6)
    base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(5 if i % 2 else 2):
            w[(i * 7 + k * 53) % 300] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    assert multiset(minhash_dedup.near_duplicates(df, 85), "doc_id", "n_shingles", "component_id", "kept") == grouped_by_hand(rows, 85)
    assert multiset(minhash_dedup.near_duplicates(df, 92), "doc_id", "n_shingles", "component_id", "kept") == grouped_by_hand(rows, 92)


def test_pairs_are_checked_in_any_band_they_share():
    import pyarrow as pa

    sketch, grams = np.zeros(minhash_dedup.COORDINATES, np.uint16).tobytes(), np.arange(50, dtype=np.uint64).tobytes()
    longs = lambda *x: pa.array(x, pa.int64())
    names = ["bk", "i", "j", "side", "cid", "comp", "band", "sk", "set"]
    rows = pa.RecordBatch.from_arrays([longs(9, 9), longs(0, 0), longs(0, 0), longs(0, 0), longs(1, 2), longs(1, 2), longs(5, 5), pa.array([sketch] * 2), pa.array([grams] * 2)], names)
    found = pa.Table.from_batches(list(minhash_dedup._blocks(100, 85)(iter([rows]))))
    assert found.to_pylist() == [{"a": 1, "b": 2}]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, 8 * n // 10)], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = (minhash_dedup.sketch(a) == minhash_dedup.sketch(b)).mean()
        assert (minhash_dedup.sketch(a) != minhash_dedup._EMPTY).all() and abs(got - true) < 0.2


def kept_by_hand(rows, percent):
    """One (doc_id, text) of each group: the smallest doc_id's; any of several equal ones."""
    alone = [k for k, r in enumerate(rows) if not (r[1] or "").split()]
    left, out = [k for k in range(len(rows)) if k not in alone], collections.Counter((rows[k][0], rows[k][1]) for k in alone)
    while left:
        group, todo = set(), [left[0]]
        while todo:
            k = todo.pop()
            group.add(k)
            for j in left:
                if j not in group and j not in todo and len({c for _, _, c, _ in grouped_by_hand([(0, rows[k][1]), (1, rows[j][1])], percent)}) == 1:
                    todo.append(j)
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out[min(ids) if ids else None, "one"] += 1
        left = [k for k in left if k not in group]
    return out


def test_first_of_groups_stay(spark):
    rng = random.Random(7)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 60)
    near = a.replace(a.split()[40], "other", 1)
    rows = [(5, a), (5, a), (3, near), (3, a), (None, near), (None, b), (None, b), (None, c), (9, c + " more"), (9, c + " more"), (None, None), (1, " "), (1, " "), (20, prose(rng, 50))]
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)).withColumn("group", F.lit("mine")).repartition(3)
    out = minhash_dedup.keep_first_of_groups(df)
    assert out.columns == df.columns
    texts = {t for _, t in rows}
    got = out.collect()
    assert all(r["text"] in texts and r["group"] == "mine" for r in got)
    assert collections.Counter((r["doc_id"], r["text"] if not (r["text"] or "").split() else "one") for r in got) == kept_by_hand(rows, 80)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    edges += [(1000, 1000), (None, 3)] + [(500, i) for i in range(501, 530)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == label


# --- 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.quality_posteriors(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("truth"))
    held = got.join(truth, "doc_id").select("kept", "truth").collect()
    right = sum(r["kept"] == (r["truth"] == 1) for r in held) / len(held)
    clean = [r["kept"] for r in held if r["truth"] == 1]
    assert right > 0.97 and sum(clean) / len(clean) > 0.99


def test_posteriors_equal_those_by_hand(spark):
    """Sites, strengths and posteriors recomputed in plain Python from the evidence of the texts."""
    rng = random.Random(21)
    rows, truth = [], {}
    for i in range(600):
        site = rng.choice(["a", "a", "a", "b", "c", None])
        ok = rng.random() < {"a": 0.9, "b": 0.2, "c": 0.5, None: 0.7}[site]
        text = prose(rng, 40) if ok else " ".join(w + "!!" for w in prose(rng, 40).split())
        rows.append((i, text, rng.choice(["en", "fr", None]), site, 0))
        if i % 3 == 0:
            truth[i] = int(ok)
    rows += [(3, rows[3][1], "en", "b", 0), (700, None, "en", "d", 0), (701, "", "fr", "a", 0)]
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    got = quality_classifier.quality_posteriors(clashing(spark.createDataFrame(rows, SCHEMA)).withColumn("host", F.lit("mine")), labels).collect()
    prior = math.log(sum(truth.values()) / (len(truth) - sum(truth.values())))
    p = {id(r): float(truth[r["doc_id"]]) if r["doc_id"] in truth else 1 / (1 + math.exp(-prior - r["evidence"])) for r in got}
    sums = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        for key in ((r["host"],), (r["host"], r["path"]), ()):
            sums[key][0] += 1
            sums[key][1] += p[id(r)]

    def by_moments(level):
        big = [(n, s) for k, (n, s) in sums.items() if len(k) == level and n >= 2]
        mu = sum(s for _, s in big) / sum(n for n, _ in big)
        tau = sum((s / n - mu) ** 2 for n, s in big) / len(big) - mu * (1 - mu) * sum(1 / n for n, _ in big) / len(big)
        return min(quality_classifier.STRONGEST, max(1.0, mu * (1 - mu) / tau - 1)) if tau > 0 else quality_classifier.STRONGEST

    mu, k_host, k_path = sums[()][1] / sums[()][0], by_moments(1), by_moments(2)
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    for r in got:
        (hn, hs), (n, s), own = sums[(r["host"],)], sums[(r["host"], r["path"])], p[id(r)]
        host = (hs - own + k_host * mu) / (hn - 1 + k_host)
        path = (s - own + k_path * host) / (n - 1 + k_path)
        quality = 1 / (1 + math.exp(-math.log(path / (1 - path)) - r["evidence"]))
        assert (r["host_posterior"], r["path_posterior"], r["quality"]) == (pytest.approx(host), pytest.approx(path), pytest.approx(quality))
        assert r["kept"] == (quality >= quality_classifier.CUT)


def test_fit_reads_bags_of_words():
    ids, n, form = quality_classifier.features("a b a a c")
    words = [b"a", b"b", b"a", b"a", b"c"]
    want = collections.Counter(zlib.crc32(w) & (quality_classifier.BUCKETS - 1) for w in words)
    assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == want and form == quality_classifier.shape(words, "a b a a c")


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_posteriors(clashing(docs), none).collect()
    assert len(got) == len(corpus()) and all(r["kept"] and r["evidence"] == 0 for r in got)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(93)] + [(93, 0, 0), (None, 1, 0), (3, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_posteriors(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r["quality"] <= 1 for r in got)
    assert quality_classifier.quality_posteriors(empty, labels).count() == 0


def test_site_posteriors_shrink(spark):
    """A sparse site stays near the global prior, a large one near its own mean."""
    sites = spark.createDataFrame([(1000, 900.0), (1000, 200.0), (1000, 500.0), (2, 2.0)], "n long, s double")
    k = quality_classifier.strength(sites)
    assert 1 <= k < 100
    assert quality_classifier.strength(spark.createDataFrame([(100, 50.0)] * 5, "n long, s double")) == quality_classifier.STRONGEST


# --- common


def test_scratch_is_shared_or_local(spark):
    assert common.scratch_dir(spark).endswith("/millrace")
    df = common.materialize(spark.range(10).withColumnRenamed("id", "x"), "t")
    assert df.count() == 10
    common.discard(df)
    assert common.small_or_whole(common.materialize(spark.range(10), "t"), 3).count() == 10


def test_sentencepiece_gives_every_segmentation(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    nul = spark.createDataFrame([(200, "ab\0cd ef", "en", "s0", 8), (201, "\0", "en", "s0", 1), (202, "a  b", "en", "s0", 4)], SCHEMA)
    texts = {r[0]: r[1] or "" for r in corpus()} | {200: "ab\0cd ef", 201: "\0", 202: "a  b"}
    encoded = sentencepiece_nbest.encode(docs.unionByName(nul), path, with_ids=True, with_nbest=True)
    model = sentencepiece_nbest.Model(path)
    score = lambda ids: sum(model.unknown_score if x == 3 else model.processor.get_score(x) for x in ids)
    for r in encoded.collect():
        found, text = r["nbest_ids"], texts[r["doc_id"]]
        assert r["round_trip"] and found[0] == r["ids"] and len({tuple(x) for x in found}) == len(found) == len(r["nbest_scores"])
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in found] == r["nbest_crc32"] and r["nbest_crc32"][0] == r["ids_crc32"]
        assert [len(x) for x in found] == r["nbest_tokens"] and all(model.processor.decode(x) == text for x in found)
        if r["doc_id"] is not None and r["doc_id"] < 80 or r["doc_id"] == 200:
            assert len(found) == 4
        if r["doc_id"] == 200:
            assert [score(x) for x in found] == pytest.approx(r["nbest_scores"])
            assert [v for _, v in model.nbest(" ab\0cd ef", 4)] == pytest.approx(r["nbest_scores"])
    back = sentencepiece_nbest.decode(encoded.select("doc_id", "ids", F.lit(1).alias("mine")), path).collect()
    assert len(back) == len(corpus()) + 3 and all(r["text"] == texts[r["doc_id"]] and r["mine"] == 1 for r in back)
