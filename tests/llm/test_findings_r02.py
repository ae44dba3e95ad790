"""Cases that the second review found missing."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.llm import boosting, byte_dedup, components, loser_tree, mixing, pii, urls, warc


def test_many_overlapping_runs_pass_the_tree_once(spark, monkeypatch):
    """5,000 runs of one piece each that all overlap, and 300 of 20 pieces: heads that
    the trees take in are at most twice the entries."""
    taken = []
    real = loser_tree.merge

    def counting(runs):
        def counted(run):
            for x in run:
                taken.append(1)
                yield x

        return real([counted(r) for r in runs])

    monkeypatch.setattr(loser_tree, "merge", counting)
    for runs, per_run, size in ((5000, 1, 64), (300, 20, 8)):
        taken.clear()
        entry = lambda k, run: (f"{k:09d}", 0, 0, "response", 0, "d", None, run, 0)
        pieces = []
        for r in range(runs):
            keys = [i * runs + r for i in range(per_run * size)]
            pieces += [(0, warc._key(entry(k[0], "")), f"r{r:05d}", [entry(x, f"r{r:05d}") for x in k]) for k in (keys[a : a + size] for a in range(0, len(keys), size))]
        pieces.sort(key=lambda x: x[:3])
        began = time.perf_counter()
        n, last = 0, ""
        for row in warc.merged(pieces):
            assert row[0] >= last
            n, last = n + 1, row[0]
        assert n == runs * per_run * size and len(taken) <= 2 * n
        assert time.perf_counter() - began < 60


def test_components_of_a_star_and_chains(spark):
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(5000, 5040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.root: r["count"] for r in components.components(star.union(chain)).groupBy("root").count().collect()}
    assert got == {0: 3000, 5000: 41}
    # tables that are left to Spark give the same
    components_rows = components.ROWS
    try:
        components.ROWS = 1
        assert {r.root: r["count"] for r in components.components(star.union(chain)).groupBy("root").count().collect()} == got
    finally:
        components.ROWS = components_rows


def test_a_new_host_of_a_bad_domain(spark):
    bad = [(f"h{i}.bad.com", 1) for i in range(20) for _ in range(10)] + [(f"h{i}.good{i}.com", 0) for i in range(80) for _ in range(10)]
    outcomes = spark.createDataFrame(bad, "host string, bad int")
    pages = spark.createDataFrame([("http://new.bad.com/x",), ("http://new.good1.com/x",), ("http://unseen.org/x",)], "url string")
    judged = lambda **k: {r.host: r.verdict for r in urls.filter_urls(pages, outcomes, rules=(), **k).collect()}
    # no host of the outcomes is in pages: all of them count for the domains
    assert judged() == {"new.bad.com": "block", "new.good1.com": "allow", "unseen.org": "allow"}
    assert set(judged(least_labelled=1).values()) == {"allow"}
    r = {x.host: x for x in urls.host_reputation(spark.createDataFrame([("new.bad.com",)], "host string"), outcomes).collect()}
    assert set(r) == {"new.bad.com"} and r["new.bad.com"].n_labelled == 0 and r["new.bad.com"].bad_rate > 0.8


def test_labelled_tables_without_anything_to_learn(spark):
    kinds = "text string, what string"
    docs = spark.createDataFrame([("write to a.b@c.org or +1 (663) 555-6869 or 5551234567",)], "text string")
    for rows in ([], [("plain words", "")], [("call 5551234567 now", "")] * 8, [(None, None)]):
        m = pii.model(spark, labelled=spark.createDataFrame(rows, kinds))
        assert m["cut"] == 1.0 and m["precision"] == m["recall"] == 0.0
        r = pii.find_pii(docs, fitted=m).first()
        assert {s.kind for s in r.spans} == {"email", "phone"} and len(r.spans) == len(r.base_spans)
    assert boosting.to_sql([], []) == "(0D)"


def chosen(rated, base):
    """Likeliest first; a span stays if it meets no base span and none that stays."""
    kept = list(base)
    for p, kind, a, b in sorted(rated, key=lambda x: (-x[0], x[2], -x[3], x[1])):
        if all(b <= s or e <= a for _, s, e in kept):
            kept.append((kind, a, b))
    return sorted(x for x in kept if x not in base)


def test_added_spans_by_brute_force(spark, sf):
    """Each candidate's chance in numpy, and the greedy choice, against the spans."""
    m = pii.model(spark)
    names = list(pii.FEATURES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "call 06 12 34 56 78 or 5551234567, sk-ab12cd34ef56ab78cd90, 123-45-6789 at john at example.com")], "doc_id long, text string"))
    found = {r.doc_id: r for r in pii.find_pii(docs, fitted=m).collect()}
    rows = docs.selectExpr("doc_id", f"inline({pii.candidates('text')})").selectExpr("doc_id", "kind", "start", "end", "inline(transform(array(struct(*)), c -> named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in pii.FEATURES.items()) + ")))")
    rated = {}
    for r in rows.collect():
        margin = boosting.margin(m["trees"], np.array([[float(r[k]) for k in names]]))[0]
        p = 1 / (1 + np.exp(-(m["a"] * margin + m["b"])))
        if p >= m["cut"]:
            rated.setdefault(r.doc_id, []).append((p, r.kind, r.start, r.end))
    assert len(found) == docs.count()
    for i, r in found.items():
        base = [tuple(s) for s in r.base_spans]
        added = sorted(tuple(s) for s in r.spans if tuple(s) not in base)
        free = [x for x in rated.get(i, []) if all(x[3] <= s or e <= x[2] for _, s, e in base)]
        assert added == chosen(free, base)
    assert sum(len(r.spans) > len(r.base_spans) for r in found.values()) > 0


def test_work_follows_the_shards_that_are_there():
    """A block among three million shards gives a row for each of its own."""
    r = np.random.default_rng(0)
    texts = ["".join(map(chr, r.integers(97, 123, 300))) for _ in range(20)] * 2
    t = pa.table({"block": pa.array([0] * 40, pa.int64()), "order": pa.array(range(40), pa.int64()), "text": texts})
    n, began = 3_000_000, time.perf_counter()
    rows = byte_dedup._hash_rows(n)(t).to_pylist()
    assert time.perf_counter() - began < 2
    assert rows and len({x["shard"] for x in rows}) == len(rows) and all(0 <= x["shard"] < n and x["data"] for x in rows)
    hashes = np.concatenate([np.frombuffer(x["data"], np.uint64) for x in rows])
    assert sorted(hashes.tolist()) == sorted(byte_dedup._Block(t).hashes(1)[0].tolist())


def test_null_ids_are_dealt(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.expr("concat('a b ', id)").alias("text"), F.lit("s").alias("source"))
    out = mixing.mix_sources(docs).agg(F.sum("taken"), F.max("copies"), F.count(F.lit(1))).first()
    assert out[2] == 2000 and out[1] <= 2 and abs(out[0] - 1.5 * 6000) <= 6
