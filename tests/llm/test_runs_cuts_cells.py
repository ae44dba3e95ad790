"""Fill-in-middle cuts, periodic runs and embedding groups against brute force."""

import hashlib
import random
import re
import typing

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import automaton, embedding_dedup, infill, periodic, suffix_tree

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def some_text(r, n):
    return "".join(r.choice(["a", "bé", "日", SPACES[r.randrange(6)], " ", "\x00", "\x1f", " ", "<"]) for _ in range(n))


def infilled(doc_id, text):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    w = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(w), "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    spm = h[3] % 100 < 80
    return len(w), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk,piece,scan", [(256, 1 << 16, 1 << 22), (4, 1 << 16, 50), (4, 7, 30), (1, 1, 1)])
def test_infill(spark, monkeypatch, chunk, piece, scan):
    """Chunks and pieces of any size, also inside a character, give the same cuts. The
    workers get the sizes with the functions."""
    monkeypatch.setattr(infill, "PIECE", piece)
    r = random.Random(7)
    texts = [None, "", " ", "a", " \n", "a ", " a", "<P>x y", "x <", "ends in <S", "a<M>b", "  b"] + [some_text(r, r.choice((3, 9, 40))) for _ in range(60)]
    rows = [(None if i == 20 else i, t) for i, t in enumerate(texts)] + [(21, texts[21])] * 3
    # repeated rows and columns with the names of new ones and of inner ones
    df = spark.createDataFrame([(*x, 5, "z", 9) for x in rows], "doc_id long, text string, n int, output string, __hash int").repartition(3)

    def with_sizes(f):
        def run(batches):
            infill.SCAN, automaton.CHUNK = scan, chunk
            yield from f(batches)

        run.__annotations__ = typing.get_type_hints(f)
        return run

    for name in ("_cut_here", "_function_of", "_find_in"):
        monkeypatch.setattr(infill, name, with_sizes(getattr(infill, name)))
    monkeypatch.setattr(automaton, "CHUNK", automaton.CHUNK)
    monkeypatch.setattr(infill, "SCAN", infill.SCAN)
    out = infill.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "__hash", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted(((x.doc_id, x.text, (x.n, x.form, x.prefix_chars, x.middle_chars, x.output)) for x in out.collect()), key=repr)
    assert got == sorted(((i, t, infilled(i, t)) for i, t in rows), key=repr)
    assert out.filter("NOT restored <=> coalesce(text, '')").count() == 0 and out.filter("form <> 'plain'").count() > 10
    assert infill.fill_in_middle(df.filter("false")).count() == 0


def test_scan_finds_every_event():
    r = random.Random(1)
    for _ in range(100):
        texts = [some_text(r, r.randrange(30)).encode() for _ in range(r.randrange(1, 6))]
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        scan = automaton.Scan(infill.TOKENS, data, sizes)
        for entry in range(3):
            # entered in a word or a gap: as if such a character stood before
            front = {0: b"", 1: b" ", 2: b"x"}[entry]
            ends = [[m.end() - len(front) for m in TOKEN.finditer((front + t).decode(errors="surrogateescape"))] for t in texts]
            left, count = scan.functions()
            for i, t in enumerate(texts):
                word_ends = [len((front + t).decode()[: e + len(front)].encode()) - len(front) for e in ends[i] if e < len((front + t).decode()) - len(front)]
                assert count[i, entry] == len(word_ends)
                for k, e in enumerate(word_ends, 1):
                    assert scan.find(np.full(len(texts), entry), np.full(len(texts), k))[i] == e
            assert (scan.find(np.full(len(texts), entry), np.zeros(len(texts), np.int64)) == 0).all()
            assert (scan.find(np.full(len(texts), entry), np.full(len(texts), 99)) == sizes).all()


def brute_runs(w, shortest, times):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


@pytest.mark.parametrize("side,leaves,few,tree", [(64, 1 << 20, 64, 1 << 18), (1, 3, 0, 10)])
def test_runs_against_brute_force(monkeypatch, side, leaves, few, tree):
    for name, v in (("SIDE", side), ("LEAVES", leaves), ("FEW", few)):
        monkeypatch.setattr(suffix_tree, name, v)
    r = random.Random(3)
    for _ in range(120):
        texts = []
        for _ in range(r.randint(1, 5)):
            n, kinds = r.choice([0, 1, 5, 30, 90]), r.choice([1, 2, 3, 50])
            w = [b"%d" % r.randrange(kinds) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(2, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        shortest, times = r.choice([(24, 3), (2, 2), (6, 3)])
        for w, (n, runs, collapsed) in zip(texts, periodic._found(texts, shortest, times)):
            want = brute_runs(w, shortest, times)
            assert (n, [(x["start"], x["length"], x["period"]) for x in runs]) == (len(w), want)
            gone = {i for s, size, q in want for i in range(s + q, s + size)}
            assert collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_collapse_runs(spark):
    rows = [(1, "x " + "a b c " * 9 + "y", 1), (2, "a " * 23, 2), (3, None, 3), (4, "", 4), (5, "z " * 24, 5), (5, "z " * 24, 5), (6, "w " * 40000 + "é", 6), (7, " \n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    out = periodic.collapse_runs(df)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in out.collect())
    assert got == [
        (1, 29, [(1, 27, 3)], "x a b c y"), (2, 23, [], "a " * 22 + "a"), (3, 0, [], ""), (4, 0, [], ""),
        (5, 24, [(0, 24, 1)], "z"), (5, 24, [(0, 24, 1)], "z"), (6, 40001, [(0, 40000, 1)], "w é"), (7, 0, [], ""),
    ]
    assert periodic.collapse_runs(df.filter("false")).count() == 0
    planted = periodic.with_planted_runs(spark.range(200).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 90), x -> concat('w', x)), ' ')").alias("text")))
    found = periodic.collapse_runs(planted).filter("size(runs) > 0").select("doc_id").collect()
    assert found and all(__import__("zlib").crc32(str(x.doc_id).encode()) % 10 == 0 for x in found)


def clusters(r, dims, sizes, spread):
    out = []
    for n in sizes:
        c = r.normal(size=dims)
        c /= np.linalg.norm(c)
        for _ in range(n):
            e = r.normal(size=dims)
            out.append(c + spread * r.random() * e / np.linalg.norm(e))
    return out


def brute_links(rows, similar):
    def good(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, up = len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= similar:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            k = root(i)
            least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(root(i)), rows[i][0] == least.get(root(i))) for i in range(n)), key=repr)


@pytest.mark.parametrize("dims,spread,cell,block", [(3, 1.2, 20, 1024), (8, 0.9, 15, 7), (16, 0.6, 40, 16), (2, 3.0, 10, 5)])
def test_cells_lose_no_link(spark, monkeypatch, dims, spread, cell, block):
    """Many small cells and blocks, clusters about as wide as the linking angle."""
    for name, v in (("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(embedding_dedup, name, v)
    r = np.random.default_rng(dims)
    vs = clusters(r, dims, [1] * 60 + [12] * 8 + [60], spread)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vs)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, [2 * x for x in rows[0][1]], 0), (0, rows[0][1], 0)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dims, 1), (2003, [nan] * dims, 1), (2004, [inf] + [1.0] * (dims - 1), 1), (2005, [None] + [1.0] * (dims - 1), 1), (2006, [1.0] * (dims + 1), 1), (2007, [1.0] * (dims + 1), 1), (2008, rows[1][1], None), (2009, rows[1][1], None), (None, rows[1][1], 1), (None, [-x for x in rows[1][1]], 1), (None, None, 0), (2010, [1e300] * dims, 0), (2011, [1e-300] * dims, 0)]
    df = spark.createDataFrame([(*x, 7) for x in rows], "vec_id long, embedding array<double>, label int, kept int")
    out = embedding_dedup.link_vectors(df)
    assert out.columns == ["vec_id", "embedding", "label", "n_links", "component_id", "kept"]
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in out.collect()), key=repr)
    with np.errstate(all="ignore"):
        small = [(i, [x / 1e300 if x and abs(x) > 1e200 and np.isfinite(x) else x * 1e300 if x and 0 < abs(x) < 1e-200 else x for x in v] if v else v, la) for i, v, la in rows]
    assert got == brute_links(small, embedding_dedup.SIMILAR)
    assert embedding_dedup.link_vectors(df.filter("false")).count() == 0
    assert embedding_dedup.link_vectors(df.filter("label IS NULL")).count() == 2


def test_a_core_needs_no_products(spark, monkeypatch):
    r = np.random.default_rng(0)
    u = np.array(clusters(r, 32, [3000] + [1] * 500, 0.05))
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = embedding_dedup.spherical_k_means(u, 8)
    gram = c @ c.T - 2 * np.eye(len(c))
    assert gram.max() < np.cos(2 * np.arccos(0.93)) + 1e-9
    best = (u[:3000] @ c.T).argmax(1)
    assert len(set(best.tolist())) == 1 and (u[:3000] @ c[best[0]]).min() > np.cos(np.arccos(0.93) / 2)
