"""Scalar functions on the edge rows, expected values by hand."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidewater.functions import dates as D
from tidewater.functions import rules as R
from tidewater.functions import scores as S
from tidewater.functions import text as T

c = F.col


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(c("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    names = ["Acme, Inc.", "Acme Co., Ltd.", "Costco", "Acme (US) LLC", "ACME CORP /DE", "ACME CORP /DE/", "", None]
    assert col(spark, names, T.clean_name) == ["acme", "acme", "costco", "acme", "acme", "acme corp /de/", "", ""]
    assert col(spark, ["Costco", "Visa", "Beta Therapeutics, Inc.", None], T.client_name) == ["cost", "vi", "beta", ""]
    assert col(spark, ["Acme, Inc.", "Acme Inc", "AcmeInc"], T.exclusion_name) == ["acme", "acme", "acmeinc"]
    assert col(spark, ["the alpha", "beta alpha", "alpha beta", "one", "a a b"], T.word_key) == [None, "alpha|beta", "alpha|beta", None, None]


def test_clean_name_is_idempotent(spark):
    names = ["Acme, Inc.", "Beta Ltd. (UK)", "Gamma /DE/", "The Co."]
    once = col(spark, names, T.clean_name)
    assert col(spark, once, T.clean_name) == once


def test_titles(spark):
    titles = ["Biostatistician (Remote)", "PV Scientist", "Chef", "(contract)", None, "Clinical Research Writer", "SPV lead"]
    assert col(spark, titles, lambda x: F.array_join(T.specialties(x), ",")) == ["Biostatistics", "Pharmacovigilance", "Other", "Other", "Other", "Clinical Monitoring,Medical Writing", "Other"]
    assert col(spark, ["Aircraft mechanic", "crab", "Chef", None], lambda x: T.has(x, T.role_pattern())) == [True, True, False, False]
    assert col(spark, ["Aircraft mechanic", "Field CRA"], lambda x: T.has(x, T.role_pattern(strict=True))) == [False, True]


def test_similar(spark):
    df = spark.createDataFrame([("acme bio", "acme b"), ("abcdefgh x", "zz abcdefgh"), ("ab", "abc"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(T.names_similar(c("a"), c("b"))).collect()] == [True, True, False, False, False]


def test_entities_and_documents(spark):
    assert col(spark, ["a &amp; b &#65;&#8217;s &#xZ;", "none", None], T.decode_entities) == ["a & b A's &#xZ;", "none", None]
    sgml = "<DOCUMENT><TYPE>EX-10\n<TEXT>no</TEXT></DOCUMENT><DOCUMENT>\n<TYPE>8-K/A\n<TEXT>yes</TEXT></DOCUMENT>"
    assert col(spark, [sgml, "x"], T.document_body) == ["yes", None]
    html = "<p>Item&#160;1.01 Entry into a Material Definitive Agreement</p><p><b>Deal</b></p><p>On May 1, the Company signed a merger agreement with Beta.</p>"
    assert col(spark, [html, "<p>x</p>"], T.item_summary) == ["On May 1, the Company signed a merger agreement with Beta.", None]


def test_deal(spark):
    rows = [("signed agreement and plan of merger, with merger consideration; Big Parent Inc (the \"Parent\") pays $2.5 billion", "Filer"), ("acquired global rights to LYL273 from Seller Bio, for $40 million", "Filer"), (None, "Filer"), ("", "Filer")]
    out = T.with_deal(spark.createDataFrame(rows, "t string, f string"), "t", "f").collect()
    assert [(r.transaction_type, r.acquirer_name, r.acquired_name, r.deal_value) for r in out] == [("merger", "Big Parent Inc", "Filer", "$2.5B"), ("product_acquisition", "Filer", "Seller Bio", "$40M"), ("acquisition", "Filer", "", None), ("acquisition", "Filer", "", None)]
    assert out[1].acquired_asset == "LYL273" and out[0].deal_summary == "Big Parent Inc is acquiring Filer for $2.5B."


def test_headlines(spark):
    t = ["Roche-Partnered Zeta Bio Nabs $20M", "China's Gamma Files for IPO", "Merck Pays $50M to get it for SmallBio's drug", "Weekly digest of news"]
    assert col(spark, t, T.headline_company) == ["Zeta Bio", "Gamma", "SmallBio", "Weekly digest of"]
    assert col(spark, ["raises $5M in series A", "IPO and merger", "buys", "nothing"], T.headline_deal) == ["venture_capital", "ipo", "ma", None]
    assert col(spark, ["for $1,200 million", "$ 3.5B", "5 million", None], T.amount) == ["$1200M", "$3.5B", None, None]


def test_dates(spark):
    assert col(spark, ["April 20, 2026", "Sept 3, 2025 x", "Feb 30, 2026", "Foo 1, 2026", None], D.named_date) == [dt.date(2026, 4, 20), dt.date(2025, 9, 3), None, None, None]
    day = F.lit("2026-05-10").cast("date")
    assert col(spark, ["3 days ago", "Last week", "2 months ago", "posted 3 days ago", ""], lambda x: D.relative_date(x, day)) == [dt.date(2026, 5, 7), dt.date(2026, 5, 3), dt.date(2026, 3, 11), None, None]
    cut = col(spark, ["2026-03-10 04:00:00", "2026-03-10 06:00:00"], lambda x: F.date_format(D.week_cutoff(x.cast("timestamp")), "MM-dd HH:mm"))
    assert cut == ["03-02 05:00", "03-03 05:00"]
    a = lambda x: D.days_between(x.cast("timestamp"), F.lit("2026-01-02 12:00:00").cast("timestamp"))
    assert col(spark, ["2026-01-02 00:00:00", "2026-01-03 00:00:00", None], a) == [1, 0, 999]


def test_scores(spark):
    assert col(spark, [-2, 0, 5, 7, 8, 10, 52, 53, 200], S.recency, "int") == [31, 25, 10, 10, 10, 11, 25, 25, 25]
    assert col(spark, [1, 18, 19, None], S.client_boost, "int") == [15, 10, 8, 15]
    assert col(spark, ["10,001+ employees", "10,001+", "51-200 employees", "Self-employed", None, ""], S.parse_size) == [10001, 10001, 51, 0, 0, 0]
    assert col(spark, ["10,001+", "Self-employed", None, "", "many"], S.size_rank) == [10001, 1, -1, -1, -1]
    phases = [["PHASE2"], ["PHASE1", "PHASE2"], ["NA"], ["EARLY_PHASE1"], [], None]
    got = col(spark, phases, S.phase, "array<string>")
    assert [(r.label, r.number, r.combined) for r in got] == [("Phase 2", 2, False), ("Phase 1/2", 2, True), ("NA", None, False), ("EARLY_PHASE1", None, False), ("N/A", None, False), ("N/A", None, False)]
    assert col(spark, ['{"a": 1, "b": "", "c": null}', "{}", None, "no json"], S.richness) == [1, 0, 0, 0]


def test_score_range(spark):
    df = spark.range(-3, 300).select(S.queue_score(c("id").cast("int"), F.lit(0), F.lit(None).cast("int"), F.lit(5), F.lit(5), F.lit(0), F.lit(15)).alias("s"))
    low, high = df.agg(F.min("s"), F.max("s")).first()
    assert low >= 10 and high <= 100


def test_words_that_patterns_need():
    need = T.needed_words
    assert need(r"merger\s+agreement") == ("agreement",) and need(r"acquir\w+\s+(?:global|all)\s+rights?\b") == ("acquir",)
    assert need(r"licensing\s+agreement|co-promotion") == ("licensing", "co-promotion") and need(r"ab|merger") == () and need(r"(?:merger|offer)") == ()
    assert need(r"plans?\b") == ("plan",) and need(r"x{3}merge[rd]?") == ("merge",)
    # every pattern that has such words fits no text without them
    r = random.Random(2)
    pieces = ["merger", "agreement", "and plan of", "acquired", "rights to", "exclusive", "license", "offering", "public", "initial", "price", "shares of common stock", "parent", "the", "tender offer", "co-promotion", "co-develop", "royalt", "milestone", "asset purchase", "(the parent)", "stock purchase agreement"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    gated = 0
    for _, each in (*R.TRANSACTIONS, *R.TRANSACTIONS_BACKFILL):
        for _, patterns, _ in each:
            for p in (x.replace("[A-Z]", "[a-z]") for x in patterns):
                words = need(p)
                gated += bool(words)
                assert all(any(w in t for w in words) for t in texts if words and re.search(p, t))
    assert gated > 60


def test_gates_change_no_kind(spark):
    r = random.Random(5)
    pieces = ["merger", "agreement and plan of merger", "acquired global rights to", "LYL273", "exclusive license", "initial public offering", "tender offer", "Big Pharma", "collaboration agreement", "asset purchase agreement", "definitive agreement to acquire", "shares of common stock", "offering price", "nothing"]
    df = spark.createDataFrame([(" ".join(r.choice(pieces) for _ in range(r.randint(0, 6))),) for _ in range(400)] + [(None,)], "t string")
    rows = df.select(T.transaction_kind(F.col("t")).alias("a"), T.transaction_kind(F.col("t"), gated=False).alias("b")).collect()
    assert all(x.a == x.b for x in rows) and len({x.a for x in rows}) == 5
