"""The eleven queries against their SQL or brute force, over the smallest tables."""

import hashlib
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import same  # noqa: E402

from tidewater.llm import byte_dedup, pii, queries, urls  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), len(byte_dedup.spans_of(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_op7(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op7_suffix_array_dedup"](spark, sf).collect())) == brute_repeats(rows)


def luhn(s):
    return sum(int(c) if (len(s) - j) % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for j, c in enumerate(s)) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_op9(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.QUERIES["op9_pii_boosting"](spark, sf).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in base) for k in PATTERNS)


HOSTILE = [
    "a.b@c.d_e@f.g x@y. @z.z a@b.c.", "1.2.3.4.5.6.7.8 01.002.0003.255 300.1.1.1 1.2.3", "é 4465758382889437 4465-7583-8288-9437 4465  7583; +1 (663) 555-6869. +12 +1 2345678 - 9",
    "4 4 6 5 7 5 8 3 8 2 8 8 9 4 3 7 1234 12-", "", None, "9" * 30000 + " " + "a." * 20000 + "@" + " +1" + " 1" * 20000, "日本 mail@x.org 日本 +81 3 1234 5678\n+", "44657583828894370000 0000000000000000",
]


def test_pii_base_on_hostile_texts(spark):
    out = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "i int, text string")).orderBy("i").collect()
    for r in out:
        assert [tuple(s) for s in r.base_spans] == base_spans(r.text)
        assert (r.redacted is None) == (r.text is None)
    assert out[1].redacted.startswith("[IP].[IP] [IP]")


def test_pii_model_on_held_out_texts(spark):
    m = pii.model(spark)
    assert m["precision"] > 0.95 and m["recall"] > 0.9 and m["brier"] < 0.03
    # another draw of invented texts
    rows = pii.sample(400, seed=99)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, text string, what string, good int")
    hit = {True: 0, False: 0}
    for r in pii.find_pii(df, fitted=m).collect():
        hit[bool(r.good)] += bool([s for s in r.spans if s.start < r.text.find(r.what or r.text) + len(r.what or r.text)])
    assert hit[True] > 0.9 * 200 and hit[False] < 0.1 * 200


def test_op2(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    out = queries.QUERIES["op2_host_reputation"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        rest = pages[r.page_id].partition("://")[2]
        host, path = re.match(r"[^/?#]*", rest).group(), re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fit = [k for k, (h, p, _) in rules.items() if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host.lower(), path, max(fit, key=len) if fit else None)
        assert r.verdict == rules[r.rule][2] if r.rule else r.verdict in ("allow", "block")


def test_host_reputation_shrinks(spark):
    bad = [("evil.spam.com", 1)] * 60 + [("fine.good.org", 0)] * 60 + [("new.spam.com", 1)] + [("a.good.org", 0)] * 20
    hosts = ["evil.spam.com", "fine.good.org", "new.spam.com", "other.spam.com", "x.co.uk", ""]
    h = spark.createDataFrame([(x,) for x in hosts], "host string")
    r = {x.host: x for x in urls.host_reputation(h, spark.createDataFrame(bad, "host string, bad int")).collect()}
    assert set(r) == set(hosts)
    assert r["evil.spam.com"].bound > 0.8 and r["evil.spam.com"].bound < r["evil.spam.com"].bad_rate and r["fine.good.org"].bad_rate < 0.1
    assert r["other.spam.com"].bad_rate > r["x.co.uk"].bad_rate > r["fine.good.org"].bad_rate
    assert (r["x.co.uk"].domain, r["x.co.uk"].suffix) == ("x.co.uk", "co.uk")
    pages = spark.createDataFrame([(f"http://{x}/p",) for x in hosts], "url string")
    v = {x.host: x.verdict for x in urls.filter_urls(pages, spark.createDataFrame(bad, "host string, bad int"), rules=()).collect()}
    assert v["evil.spam.com"] == "block" and v["fine.good.org"] == "allow" and v["x.co.uk"] == "allow"
    none = urls.filter_urls(pages, spark.createDataFrame([], "host string, bad int")).collect()
    assert {x.verdict for x in none if x.rule is None} == {"allow"}
