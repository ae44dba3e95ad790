"""The corpus pipeline, each stage against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import common, shingles


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(common.stored(f(spark, out[-1], sf), "test"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])
    assert set(stages[0].columns) < set(stages[5].columns)


def test_near_copies(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {i: set(shingles.shingles(t, 5).tolist()) for i, t in before.items()}
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    like = lambda a, b: len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) > 0
    ids = sorted(before)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if like(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert sorted(after) == sorted({root(i) for i in ids})


def test_leaks(spark, sf, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [set(shingles.shingles(r.text, 5, short=False).tolist()) for r in common.table(spark, sf, "benchmark").collect()]
    for i, t in before.items():
        s = set(shingles.shingles(t, 5).tolist())
        assert (i in after) == (not any(x and 100 * len(s & x) >= 80 * len(x) for x in items))


def test_redaction(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())
    assert not [t for t in after.values() if "@mail" in t] and [t for t in after.values() if "[EMAIL]" in t]


def test_mix(stages):
    taken = stages[5].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies")).collect()
    assert taken and all(r.n == r.copies <= 2 for r in taken)


def test_empty(spark, sf, stages):
    docs = stages[0].limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
    assert docs.count() == 0


def test_extra_columns(spark, sf, stages):
    docs = stages[0].limit(60).withColumn("item_id", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("copies", F.lit(0)).withColumn("Redacted", F.lit(0))
    for _, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() > 0
