"""Operators on small tables: nulls, empty and long texts, ties, repeated rows,
empty tables, columns with clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import byte_dedup, chat, common, components, contamination, licenses, loser_tree, mixing, ngram_join, pii, quality, shingles, signature_tree, suffix_array, urls, warc
from tidewater.llm.license_texts import KNOWN

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in every column, repeated rows, empty and long texts."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20000))
    rows = [(1, "a b c d e f g " * 5, "en", "s1", 70), (1, "a b c d e f g " * 5, "en", "s1", 70), (2, None, "en", None, None), (3, "", None, "s1", 0), (None, "x y z " * 20, "en", "s2", 1), (None, None, None, None, None), (4, " \n\t ", "de", "s2", 4), (5, long, "en", "s1", 9), (6, long + " tail", "en", "s1", 9), (7, "é日本 \x00 " * 30, "fr", "", 3)]
    # extra columns named like outputs and internals
    return spark.createDataFrame([(*r, 1, "k", 2.0, "t") for r in rows], DOCS + ", kept int, size string, target double, SPANS string")


OPERATORS = {
    "quality": lambda d: quality.judge_quality(d),
    "join": lambda d: ngram_join.ngram_join(d),
    "near duplicates": lambda d: ngram_join.drop_near_duplicates(d),
    "mix": lambda d: mixing.mix_sources(d),
    "copies": lambda d: mixing.emit_copies(mixing.mix_sources(d)),
    "pii": lambda d: pii.find_pii(d),
    "licenses": lambda d: licenses.scan_licenses(d),
    "repeats": lambda d: byte_dedup.remove_repeats(d),
    "leaks": lambda d: contamination.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}
ROWS = {"join": 10, "quality": 10, "mix": 10, "pii": 10, "licenses": 10, "repeats": 10, "leaks": 10}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_hostile_rows(hostile, name):
    out = OPERATORS[name](hostile).collect()
    if name in ROWS:
        assert len(out) == ROWS[name]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(hostile, name):
    assert OPERATORS[name](hostile.limit(0)).collect() == []


def test_defined_results(hostile):
    q = quality.judge_quality(hostile).filter("doc_id IN (2, 3, 4)").collect()
    assert [(r.n_words, r.base_failed, r.kept, r.reason) for r in q] == [(0, True, False, "base")] * 3
    j = ngram_join.ngram_join(hostile).collect()
    assert sorted((r.doc_id, r.component_id) for r in j if r.doc_id) == [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert sorted(r.doc_id or 0 for r in ngram_join.drop_near_duplicates(hostile).collect()) == [0, 0, 1, 2, 3, 4, 5, 7]
    m = {r.doc_id: r for r in mixing.mix_sources(hostile).collect() if r.doc_id}
    assert m[2].taken == 0 and m[3].taken == 0 and m[2].target == 0


def groups(texts, k, p, q):
    sets = [set(shingles.shingles(t, k).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and q * len(sets[i] & sets[j]) >= p * u:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("similar,block", [((80, 100), 512), ((90, 100), 4), ((60, 100), 3)])
def test_join_against_all_pairs(spark, monkeypatch, similar, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(5)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice((3, 8, 12, 40, 90)))] for _ in range(14)]
    texts = []
    for b in base:
        for _ in range(r.choice((1, 2, 9))):
            w = list(b)
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                w[r.randrange(len(w))] = f"v{r.randrange(50)}"
            texts.append(" ".join(w + [f"u{r.randrange(9)}"] * r.choice((0, 1))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.component_id for x in ngram_join.ngram_join(df, words=3, similar=similar).orderBy("doc_id").collect()]
    assert got == groups(texts, 3, *similar)


def test_tree_prunes_no_pair():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60 if i % 3 else 2**40, r.integers(1, 40)).astype(np.uint64)) for i in range(90)]
    bits = np.stack([signature_tree.bitmap(s, 128) for s in sets])
    tree = signature_tree.SignatureTree(np.array([len(s) for s in sets]), bits)
    other = signature_tree.SignatureTree(np.array([len(s) for s in sets[:30]]), bits[:30])
    pairs = {(min(a, b), max(a, b)) for i, j in signature_tree.dual_traversal(tree, tree, 50, 100) for a, b in zip(i.tolist(), j.tolist())}
    cross = {(a, b) for i, j in signature_tree.dual_traversal(other, tree, 50, 100) for a, b in zip(i.tolist(), j.tolist())}
    for a in range(90):
        for b in range(90):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 50 * (len(sets[a]) + len(sets[b]) - common):
                assert a >= b or (a, b) in pairs
                assert a >= 30 or (a, b) in cross


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_targets_by_hand(spark):
    def brute(sizes):
        names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
        w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
        while True:
            left = total - sum(target.values())
            over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
            if not over:
                return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
            for s in over:
                target[s] = 2.0 * sizes[s]
                free.discard(s)

    for sizes in ({"a": 100, "b": 5, "c": 50, None: 30}, {"a": 1, "b": 1000}, {"a": 10}, {"é": 7, "z": 70, "B": 700, "a": 7, "": 3}):
        rows = [(i, " ".join(["x"]), s) for s, n in sizes.items() for i in range(n)]
        out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        want = brute(sizes)
        taken = {s: sum(r.taken for r in out if r.source == s) for s in sizes}
        for s in sizes:
            assert next(r.target for r in out if r.source == s) == pytest.approx(want[s])
            assert abs(taken[s] - want[s]) <= 1
        assert all(r.copies <= 2 for r in out)


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|x", "plain", "", None, "<|", "|>", "a<", "\\", "<|im_end|>\n<|im_start|>assistant\n", "日本<|im_start|>"]
    rows = [(i, t, ("user", "assistant")[t % 2], odd[(i + t) % len(odd)]) for i in range(len(odd)) for t in range(4)]
    rows += [(50, 0, "we\nird\\<|im_end|>", "x"), (50, None, None, None), (None, 1, "assistant", "y"), (51, 1, "assistant", "same"), (51, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(df.withColumn("turns", F.lit(1))).collect()}
    assert len(out) == len(odd) + 3 and all(r.round_trip for r in out.values())
    for i in range(len(odd)):
        assert [t.text for t in out[i].turns] == [odd[(i + t) % len(odd)] or "" for t in range(4)]
        for s, t in zip(out[i].spans, (1, 3)):
            text = odd[(i + t) % len(odd)] or ""
            assert out[i].formatted[s.start : s.end] in (text, __import__("re").sub(r"<(\\*)\|", r"<\\\1|", text))
    assert out[50].escape_level == 2 and [t.role for t in out[50].turns] == ["", "we\nird\\<|im_end|>"]
    assert len(out[51].turns) == 2 and chat.format_chats(df.limit(0)).count() == 0


def test_licenses(spark):
    mit = KNOWN[0][2]
    rows = [(1, "MIT Licence\n\nCopyright (c) 2020 Foo\nAll rights reserved.\n\n" + mit.upper()), (2, mit.replace("Software", "software") + " extra"), (3, "text\nReleased under the MIT Licence!\nmore"), (4, None), (5, "the the"), (6, mit), (6, mit)]
    out = sorted(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("LICENSE_ID", F.lit(0))).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.license_id, r.notice_ids) for r in out] == [(1, "MIT", ""), (2, None, ""), (3, None, "MIT"), (4, None, ""), (5, None, ""), (6, "MIT", ""), (6, "MIT", "")]


def test_contamination(spark):
    r = random.Random(8)
    item = [f"q{r.randrange(900)}" for _ in range(30)]
    noise = lambda n: [f"n{r.randrange(5000)}" for _ in range(n)]
    one = list(item)
    one[15] = "other"
    docs = [(1, noise(9000) + item + noise(9000)), (2, noise(30) + one + noise(20)), (3, noise(300)), (4, item[:12] + noise(50)), (5, [w.upper() for w in item]), (5, [w.upper() for w in item])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(6, None), (7, "")], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, "too short"), (12, None), (None, "a b c d e f")], "item_id long, text string")
    out = sorted(((x.doc_id, x.item_ids) for x in contamination.decontaminate(df, items).collect()), key=str)
    assert out == [(1, [10]), (2, [10]), (3, []), (4, []), (5, [10]), (5, [10]), (6, []), (7, [])]
    assert not contamination.decontaminate(df, items.limit(0)).filter("contaminated").count()


def test_contamination_with_a_full_filter(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a = sorted(map(tuple, contamination.contained_items(docs, items).collect()))
    monkeypatch.setattr(common, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(common, "BITS", 0)
    assert sorted(map(tuple, contamination.contained_items(docs, items).collect())) == a


def test_contamination_repeated_and_scattered(spark):
    """Against brute force: items of many repeated shingles, and such whose
    shingles stand far apart in a document."""
    r = random.Random(3)
    noise = lambda n: [f"n{r.randrange(4000)}" for _ in range(n)]
    items, docs = {}, {}
    for i in range(40):
        n = r.choice((5, 6, 9, 20, 60, 200))
        words = [f"i{i}w{j}" for j in range(n)]
        if i % 4 == 0:
            words = words[:5] * 12 + words
        items[i] = words
        pieces = [words[j : j + 14] for j in range(0, len(words), 10)] if i % 3 == 0 else [words[: max(5, int(len(words) * r.choice((0.6, 0.85, 1.0))))]]
        docs[100 + i] = sum((noise(r.choice((10, 700))) + p for p in pieces), []) + noise(50)
    gram = lambda w: {" ".join(w[j : j + 5]) for j in range(len(w) - 4)}
    want = sorted((d, i, len(gram(x) & gram(w)), len(gram(w))) for d, x in docs.items() for i, w in items.items() if 100 * len(gram(x) & gram(w)) >= 80 * len(gram(w)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = contamination.contained_items(df, it).join(df.select("doc_id", contamination.row_key("text").alias("row")), "row")
    assert sorted((x.doc_id, x.item_id, x.n_shared, x.n_item) for x in found.collect()) == want and len(want) > 20


def test_quality_cutoffs_adapt(spark):
    r = random.Random(1)
    clean = lambda extra="": " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + extra for _ in range(60))
    rows = [(i, clean(), "en", "s", 0) for i in range(80)] + [(100 + i, clean("#$%"), "en", "s", 0) for i in range(5)] + [(200 + i, clean("#$%"), "en", "code", 0) for i in range(80)]
    out = {x.doc_id: x.kept for x in quality.judge_quality(spark.createDataFrame(rows, DOCS)).collect()}
    # marks are a fault where they are rare, and none in a source that is full of them
    assert all(out[i] for i in range(80)) and not any(out[100 + i] for i in range(5)) and all(out[200 + i] for i in range(80))


def test_stats_by_hand():
    s = dict(zip(quality.STATS, quality.text_stats("a b\na b\n\n \nc# é$")))
    assert s == {"n_words": 6, "word_chars": 8, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 0, "n_lines": 3}
    w = "one two three four five six seven eight "
    assert quality.text_stats(w * 2)[4] == 16 and quality.text_stats(w)[4] == 0 and quality.text_stats(w + "x " + w)[4] == 16


def test_loser_tree():
    r = random.Random(4)
    for k in range(10):
        runs = [sorted((r.randrange(9), i) for _ in range(r.randrange(7))) for i in range(k)]
        assert list(loser_tree.merge(runs)) == sorted(x for run in runs for x in run)


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "http://a.org/x", big), (2, "http://www.a.org:80/x#f", big), (3, None, "small"), (4, "http://a.org/x", "small"), (None, "bad\r\nWARC/1.1", big), (5, "u", None), (2, "http://a.org/x", big), (6, "http://b.org/", "a\r\n\r\nWARC/1.1\r\nb" + big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1))
    out = warc.archive(df).collect()
    got = {(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in out}
    assert len(out) == 8 and got == {(1, "revisit", 1500, 2), (2, "response", 1500, None), (3, "response", 5, None), (4, "response", 5, None), (None, "revisit", 1500, 2), (5, "response", 0, None), (6, "response", 1516, None)}
    keys = [(r.url_key, r.captured) for r in out]
    assert keys == sorted(keys) and ("org,a)/x", warc.EPOCH + 1) in keys
    assert warc.archive(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for n in (1, 2, 60, 700):
        for letters in (1, 2, 26):
            s = r.integers(97, 97 + letters, n).astype(np.uint8)
            b = s.tobytes()
            order, rank = suffix_array.suffix_array(s, 1 << 12)
            assert [b[i:] for i in order] == sorted(b[i:] for i in range(n))
            lcp = suffix_array.common_prefixes(s, order, rank, 50)
            for i in range(1, n):
                x, y = b[order[i - 1] :], b[order[i] :]
                assert lcp[i] == next((k for k in range(min(len(x), len(y), 50)) if x[k] != y[k]), min(len(x), len(y), 50))


def test_repeats_with_small_shards(spark, monkeypatch):
    from test_contracts import brute_repeats

    for name, v in {"BLOCK_BYTES": 900, "HASH_BYTES": 200, "SHARD_BYTES": 900, "ARRAY_BYTES": 400, "MANY": 2, "CHUNK": 64}.items():
        monkeypatch.setattr(byte_dedup, name, v)
    r = random.Random(6)
    passage = "".join(r.choice("abc ") for _ in range(180))
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(90))) + passage[r.randrange(60) :][: r.randrange(120)] + "é" * r.randrange(40)) for i in range(40)] + [(90, "z" * 200), (91, "z" * 120), (92, "z" * 49), (93, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = byte_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect())) == brute_repeats(rows)


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y"), (4, "http://net"), (5, "x://net/"), (5, "x://net/"), (6, "http://notnet/")]
    out = {r.id: r for r in urls.filter_urls(spark.createDataFrame(rows, "id int, url string").withColumn("Verdict", F.lit(1)), spark.createDataFrame([], "host string, bad int")).collect()}
    assert (out[1].host, out[1].path, out[2].host, out[2].rule) == ("", "", "", None)
    assert (out[3].host, out[3].path, out[3].rule, out[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (out[4].path, out[4].rule) == ("", None) and out[5].verdict == "block" and out[6].rule is None
