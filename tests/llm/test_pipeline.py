"""The pipeline against the stages done by hand on a small corpus."""

import collections

import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import SCHEMA, corpus, cut_by_hand, filled_by_hand, grouped_by_hand, measured_by_hand

import corpus_pipeline
from millrace.llm import sentencepiece_nbest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [r for r in corpus() if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    def step(k):
        nonlocal docs
        out = stages[k](spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        return [tuple(r) for r in docs.collect()]

    # quality: 30 labels prove no cutoff, so the base rules alone decide
    good = []
    for r in kept:
        m = measured_by_hand(r[1])
        if not (m[0] < 50 or 100 * m[4] > 50 * m[0]):
            good.append(r)
    assert collections.Counter(step(0)) == collections.Counter(good)

    first = {k[0] for k in grouped_by_hand(good, 80) if k[3]}
    left = step(1)  # one row of each group, also of the document that is there three times
    assert set(left) <= set(good) and len(left) == len({r[0] for r in left})
    assert {(r[0], r[1]) for r in left} == {(r[0], r[1]) for r in good if r[0] in first}

    cut = cut_by_hand(left)
    got = step(2)
    assert collections.Counter((r[0], r[1]) for r in got) == cut

    sizes = collections.Counter()
    for r in got:
        sizes[r[3]] += len(r[1].split())
    target = filled_by_hand(sizes)
    mixed = step(3)
    taken, seen = collections.Counter(), collections.Counter(mixed)
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    assert set(mixed) <= set(got) and max(seen[r] // collections.Counter(got)[r] for r in set(mixed)) <= 3
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(len(r[1].split()) for r in got if r[3] == s)

    model = sentencepiece_nbest.Model(public_tokenizers.path("piece_bpe_32k.model"))
    last = stages[4](spark, docs, folder).collect()
    whole = corpus_pipeline.run(spark, folder).collect()
    texts = collections.Counter((r[0], r[1].replace("▁", " ")) for r in mixed)
    for rows in (last, whole):
        assert collections.Counter((r["doc_id"], model.decode(np.array(r["ids"], "<u4")).decode()) for r in rows) == texts


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
