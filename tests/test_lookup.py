"""Lookups with hot and missing keys, span index, prefix joins and the waterfall."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.operators import enrichment, resolve
from tidewater.operators.lookup import lookup, prefixes_in

c = F.col


@pytest.fixture
def sorted_joins(spark):
    """No broadcasts and many partitions, so that a hot task shows."""
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_missing_and_hot_keys_meet_in_no_task(spark, sorted_joins):
    n = 16000
    # nine of ten rows have no key, in two forms; half of the others share one
    df = spark.range(n).select("id", F.expr("CASE WHEN id % 20 = 0 THEN 'hot' WHEN id % 20 = 1 THEN 'k' || id WHEN id % 2 = 0 THEN '' END AS k"))
    table = spark.createDataFrame([("hot", 1), ("k21", 2), ("", 3)], "k string, v int")
    out = lookup(df, table, ["k"])
    assert out.columns == ["k", "id", "v"]
    assert {(r.v, r["count"]) for r in out.groupBy("v").count().collect()} == {(1, n // 20), (2, 1), (None, n - n // 20 - 1)}
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * n / 16
    # hot rows alone are dealt too
    hot = lookup(df.filter("k = 'hot'"), table, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) >= 4


def test_lookup_of_two_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", 1)], "k string, n int")
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, v string")
    assert {(r.k, r.n, r.v) for r in lookup(df, table, ["k", "n"]).collect()} == {(None, 1, None), ("a", 1, "x"), ("a", None, None), ("b", 1, None)}


def test_sponsor_layers_with_missing_keys(spark, sorted_joins):
    directory = spark.createDataFrame([(f"Omega {i} Labs", "11-50", None if i % 2 else f"d{i}.org") for i in range(30)] + [("Acme Bio", "11-50", None), ("Acme", "51-200", None), ("Zeta", "1", None), ("Zetabet Labs", "11-50", None)], "name string, size string, domain string")
    rows = [("Acme Bioscience Inc", None), ("Acme Labs", None), ("Zeta Two", None), ("Zeta", None), ("Nobody At All", None), ("X", ["a@d4.org"]), ("", None), (None, None)]
    sponsors = spark.createDataFrame(rows * 3, "sponsor string, emails array<string>")
    got = {(r.sponsor, r.matched_name, r.matched_via) for r in resolve.match_sponsor(sponsors, directory).collect()}
    assert got == {
        ("Acme Bioscience Inc", "Acme", "keyword"), ("Acme Labs", "Acme", "keyword"), ("Zeta Two", "Zeta", "keyword"), ("Zeta", "Zeta", "exact_name"),
        ("Nobody At All", "Nobody At All", "no_match"), ("X", "Omega 4 Labs", "email_domain"), ("", "", "no_match"), (None, None, "no_match"),
    }
    assert resolve.match_sponsor(sponsors, directory).count() == len(rows) * 3


def brute_titles(titles, directory, alternates, cleaned):
    out = {}
    for i, t in titles:
        found, t = [], (t or "").lower()
        words = list(dict.fromkeys(re.findall("[a-z0-9]+", t)))
        for name in dict.fromkeys(n.strip() for n in directory if n and n.strip()):
            x = cleaned[name].lower()
            if len(x) >= 3 and re.search("[a-z0-9]", x) and x not in R.GENERIC_TERMS and t.startswith(x) and not re.match("[a-z0-9]", t[len(x) : len(x) + 1]):
                found.append((1, 0, -len(x), name))
        for alt, name in set(alternates):
            x = alt.strip().lower()
            first = re.search("[a-z0-9]+", x)
            at = t.find(x)
            if len(x) >= 3 and first and first.group() in words and at >= 0 and not (at and re.match("[a-z0-9]", t[at - 1])) and not re.match("[a-z0-9]", t[at + len(x) : at + len(x) + 1]):
                found.append((2, words.index(first.group()), -len(x), name))
        best = {}
        for f in sorted(found):
            best.setdefault(f[3].lower(), f)
        out[i] = [f[3] for f in sorted(best.values())] or None
    return out


def test_span_index_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice(["acme", "the", "zeta", "o", "é", "bio", "(us)", "a-b", "9", "biotech", "omega's", "&"])
    phrase = lambda n: " ".join(word() for _ in range(n))
    directory = [phrase(r.randint(1, 3)).title() for _ in range(60)] + ["", None, "  "]
    alternates = [((r.choice(["", "(", "-"]) + phrase(r.randint(1, 3))), r.choice(directory[:60]).strip()) for _ in range(60)]
    titles = [(i, r.choice(["", "x", "("]) + phrase(r.randint(1, 7))) for i in range(150)] + [(900, None), (901, ""), (902, "acmeacme acme zeta")]
    d = spark.createDataFrame([(x,) for x in directory], "name string")
    cleaned = {x.n: x.c for x in d.select(F.trim("name").alias("n"), T.news_name(F.trim("name")).alias("c")).collect()}
    got = {x.id: x.matched_names for x in resolve.match_titles(spark.createDataFrame(titles, "id int, title string"), d, spark.createDataFrame(alternates, "alternate_name string, directory_name string")).collect()}
    want = brute_titles(titles, directory, [(a, n) for a, n in alternates if n], cleaned)
    assert {k: v and sorted(v) for k, v in got.items()} == {k: v and sorted(v) for k, v in want.items()}
    assert sum(v is not None for v in got.values()) > 20
    assert got == want


def test_span_index_makes_no_pairs_of_a_common_first_word(spark):
    """A thousand names that begin with one word, of five lengths: a title has five
    stretches, and meets only the names that it holds."""
    names = spark.range(1000).select(F.lit("the").alias("__w"), F.expr("'the n' || id").alias("__core"))
    titles = spark.range(200).select(c("id").alias("__id"), F.expr("'the n' || id || ' and so on'").alias("__t")).withColumn("__words", F.array(F.struct(F.lit("the").alias("word"), F.lit(1).alias("place"))))
    spans = resolve.title_spans(titles, names)
    assert spans.count() <= 3 * 200
    assert spans.join(names, ["__w", "__core"]).count() == 200


def test_prefix_joins_have_no_residual(spark):
    r = random.Random(6)
    name = lambda: "".join(r.choice("ab ") for _ in range(r.randint(1, 6))).strip() or "a"
    left, right = [name() for _ in range(80)], [name() + r.choice(["", " Inc."]) for _ in range(25)]
    n, e = (spark.createDataFrame([(x,) for x in v], "name string") for v in (left, right))
    plain = lambda v: {x.name: x.p for x in v.select("name", T.exclusion_name(c("name")).alias("p")).collect()}
    a, b = plain(n), set(plain(e).values()) - {""}
    want = {x for x, p in a.items() if p and any(p.startswith(q) or q.startswith(p) for q in b)}
    assert {x.name for x in resolve.excluded(n, e).collect()} == want and want
    # as many rows as lengths occur, whatever the number of others
    x = spark.createDataFrame([("university of x",)], "t string")
    others = spark.range(500).select(F.expr("'university ' || id").alias("o"))
    assert prefixes_in(x, "t", others, "o").count() == 3


def test_dismissal_rules(spark):
    items = spark.createDataFrame([(1, "Acme", "x"), (2, "Beta", "x"), (3, None, ""), (4, "", "y")], "id int, company string, location string")
    rules = spark.createDataFrame([("job", "company", "ACME", True), ("job", "location", "y", True), ("other", "company", "Beta", True), ("job", "company", "beta", False), ("job", "company", "", True)], "signal_type string, rule_type string, rule_value string, auto_exclude boolean")
    left = resolve.without_dismissed(items, rules, F.lit("job"), company=c("company"), location=c("location"))
    assert left.columns and sorted(r.id for r in left.collect()) == [2, 3]
    assert resolve.without_dismissed(items, rules.limit(0), F.lit("job"), company=c("company")).count() == 4


def test_waterfall_stops(spark):
    """The third source is never read: nothing is open; the second is asked for two."""
    signals = spark.createDataFrame([(1, "A", None, "$1M", "P"), (2, "B", "", None, ""), (3, "C", "ipo", "", "Q"), (4, None, None, None, None)], "id int, company_name string, transaction_type string, deal_value string, counterparty string")
    posts = spark.createDataFrame([("b", "merger", "u-b"), ("C", "acquisition", "u-c")], "company_name string, transaction_type string, source_url string")
    deal = F.struct(c("v").alias("deal_value"), c("p").alias("counterparty"), c("s").alias("deal_summary"), c("u").alias("source_url"))
    pages = lambda *rows: spark.createDataFrame(list(rows), "company_name string, v string, p string, s string, u string")
    fail = F.raise_error(F.lit("asked in vain")).cast("string")
    one = enrichment.Source("one", pages(("B", "$2M", "", "s", "w2"), ("b", "$3M", "", "t", "w1"), ("A", "$9M", "Z", "", "")), F.when(c("company_name") == "A", F.struct(*[fail.alias(x) for x in ("deal_value", "counterparty", "deal_summary", "source_url")])).otherwise(deal))
    two = enrichment.Source("two", pages(("C", "$5M", "W", "late", "w3"), ("B", "$7M", "R", "other", "w4")), deal)
    three = enrichment.Source("three", pages(("Q", "", "", "", "")), F.struct(*[fail.alias(x) for x in ("deal_value", "counterparty", "deal_summary", "source_url")]))
    four = enrichment.Source("four", spark.range(1).select(fail.alias("company_name")), deal)
    got = {r.id: r for r in enrichment.enrich_deals(signals, posts, [one, two, three, four]).collect()}
    row = lambda i: (got[i].transaction_type, got[i].deal_value, got[i].counterparty, got[i].deal_summary, got[i].enrichment_url, got[i].enrichment_source, got[i].n_asked)
    assert row(1) == (None, "$1M", "P", None, None, "filing", 0)
    assert row(2) == ("merger", "$3M", "R", "t", "u-b", "posts", 2)
    assert row(3) == ("ipo", "$5M", "Q", "late", "u-c", "two", 2)
    assert row(4) == (None, None, None, None, None, None, 0)
