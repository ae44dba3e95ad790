"""Operators on small tables, sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import dedup, resolve, state
from tidewater.operators import tables as O
from tidewater.plans import agents
from tidewater.sources import readers, sinks
from tidewater.streaming import ingest

c = F.col


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_merge_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (None, None)], "k int, v string")
    assert sorted(rows(O.merge(old, new, ["k"])), key=str) == [(1, "b"), (2, "c"), (None, None)]
    assert sorted(rows(O.merge(old, new, ["k"], incoming_wins=False)), key=str) == [(1, "a"), (2, "c"), (None, "n")]
    with pytest.raises(ValueError):
        O.exactly_one(new)


def test_excluded_prefixes(spark):
    names = spark.createDataFrame([("Roche",), ("Rochester Bio Inc",), ("Ro",), ("Acme",), ("",), (None,)], "name string")
    gone = spark.createDataFrame([("Roche Inc.",), ("Acme Holdings Worldwide",)], "name string")
    assert sorted(r[0] for r in resolve.excluded(names, gone).collect()) == ["Acme", "Ro", "Roche", "Rochester Bio Inc"]
    assert resolve.excluded(names, gone.limit(0)).count() == 0


def test_title_match(spark):
    directory = spark.createDataFrame([("Acme Inc.",), ("Acme Bio",), ("Biotech",), ("Al",)], "name string")
    alt = spark.createDataFrame([("omega", "Omega Ltd"), ("acme", "Acme Inc.")], "alternate_name string, directory_name string")
    titles = spark.createDataFrame([(1, "Acme Bio raises"), (2, "Acmes rise"), (3, "megaomega then omega"), (4, "to Omega: news of acme"), (5, "Biotech up"), (6, None)], "id int, title string")
    got = dict(rows(resolve.match_titles(titles, directory, alt)))
    # only the first place of an alternate name is tested for word breaks
    assert got == {1: ["Acme Bio", "Acme Inc."], 2: None, 3: None, 4: ["Omega Ltd", "Acme Inc."], 5: None, 6: None}


def test_clients(spark):
    clients = spark.createDataFrame([("Rho", 2, True), ("Alpha Beta Pharma", 1, True), ("Gone", 3, False)], "name string, rank int, is_active boolean")
    names = spark.createDataFrame([("Rhonda Labs",), ("rho",), ("Rho Labs Inc",), ("Beta Alpha",), ("Gone",), ("",)], "name string")
    got = {r.name: (r.client, r.rank) for r in resolve.match_clients(names, clients).collect()}
    assert got == {"rho": ("Rho", 2), "Rho Labs Inc": ("Rho", 2), "Beta Alpha": ("Alpha Beta Pharma", 1)}


def test_greedy_elimination(spark):
    deals = spark.createDataFrame(
        [(1, "Acme Bio", None, "Target One", '{"a": 1, "b": 2}', "2026-01-03"), (2, "Target One", None, "Acme Bio", '{"a": 1}', "2026-01-02"), (3, "Acme Bio", None, "Target One", '{"a": 1}', "2026-01-01")],
        "id int, company string, acquirer string, acquired string, detail string, at string",
    ).withColumn("at", c("at").cast("timestamp"))
    assert rows(dedup.fuzzy_deals(deals)) == [(2,)]


def test_contacts(spark):
    kinds = "linkedin_url string, original_title string, original_company string, current_title string, current_company string, current_location string, job_history array<struct<role: string, company: string>>, last_change_type string, last_enrichment_date date"
    contacts = spark.createDataFrame([("u1", "CRA", "Old", "Lead", "Old", "X", [], None, None), ("u2", "CRA", "Old", "CRA", "Old", "X", None, "role_changed", None), ("u3", "", "", "A", "B", "X", [], None, None)], kinds)
    new = spark.createDataFrame([("U1", "Head", "New", "X"), ("u2", "cra ", "OLD", "Y"), ("u3", "A", "B", None)], "linkedin_url string, title string, company string, location string")
    got = {r.linkedin_url: r for r in state.update_contacts(contacts, new, "2026-01-01").collect()}
    a, b, d = got["u1"], got["u2"], got["u3"]
    assert (a.original_title, a.current_title, a.last_change_type, [tuple(x) for x in a.job_history]) == ("Lead", "Head", "both_changed", [("CRA", "Old")])
    assert (b.current_title, b.current_location, b.last_change_type, b.job_history) == ("CRA", "Y", None, None)
    assert (d.original_title, d.last_change_type, d.job_history) == ("A", None, [])


def test_state(spark):
    old = spark.createDataFrame([("A", 20000), ("B", 20000)], "name string, members int")
    seen = spark.createDataFrame([("a", 5), ("C", 10001)], "name string, members int")
    assert sorted(rows(state.exclusion_update(old, seen))) == [("A", 5, False), ("B", 20000, True), ("C", 10001, True)]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, original_email string")
    b = spark.createDataFrame([(2, "z")], "id int, email string")
    left, right = state.move_rows(a, b, spark.createDataFrame([(1,), (2,)], "id int"), {"original_email": "email"})
    assert rows(left) == [] and sorted(rows(right)) == [(1, "x"), (2, "z")]


def test_readers(spark, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Acme Bio", "class": "INDUSTRY"}}, "statusModule": {"startDateStruct": {"date": "2026-03"}, "studyFirstPostDateStruct": {"date": "2026-02-20"}}, "designModule": {"phases": ["PHASE2"]}, "contactsLocationsModule": {"locations": [{"country": "France"}]}}}
    other = {"protocolSection": {"identificationModule": {"nctId": "N2"}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Beta Bio", "class": "INDUSTRY"}}, "designModule": {"phases": ["PHASE1"]}, "statusModule": {"studyFirstPostDateStruct": {"date": "2026-02-20"}}}}
    (tmp_path / "s.json").write_text(json.dumps({"studies": [study, other]}))
    s = readers.studies(spark, str(tmp_path / "s.json")).cache()
    assert rows(s.select("nct_id", "in_us"), "nct_id") == [("N1", False), ("N2", True)]
    assert readers.late_phase(s).count() == 1 and readers.starting_near(s, "2026-03-10").count() == 1
    none = spark.createDataFrame([], "company_name string, signal_type string, source_url string, name string")
    clients = spark.createDataFrame([("Beta", 1, True)], "name string, rank int, is_active boolean")
    out = agents.trial_signals(s, none, none.select("name"), none.select("company_name", "signal_type"), clients, "2026-03-01").collect()
    assert [(r.company_name, r.signal_type, r.priority_score) for r in out] == [("Beta Bio", "clinical_trial_new_ind", 37)]
    (tmp_path / "f.json").write_text(json.dumps({"hits": {"hits": [{"_source": {"ciks": ["0007"], "adsh": "1-2-3", "display_names": ["Acme Inc (ACM) (CIK 7)"], "file_date": "2026-01-02", "items": ["1.01"]}}]}}))
    f = readers.filings(spark, str(tmp_path / "f.json")).first()
    assert (f.company_name, f.ticker, f.filing_url) == ("Acme Inc", "ACM", "https://filings.example/data/7/123/1-2-3.txt")
    (tmp_path / "d.csv").write_text("Name,Primary Industry,Size,Type,Location,Country,Domain,LinkedIn URL\n Acme ,Bio,10,,,US,a.com,http://x/\nAcme,,,,,,b.com,http://x\n,,,,,,,\nBeta\n")
    assert sorted(r.name for r in readers.directory_csv(spark, str(tmp_path / "d.csv")).collect()) == ["Acme", "Beta"]


def test_cards(spark):
    html = '<div class="PagePromo-title"><a class="Link" href="/a">A &amp; B</a></div><div class="PagePromo-date">April 2, 2026</div><div class="PagePromo-title"><a href="/b" class="Link">C</a></div>'
    got = readers.news_cards(spark.createDataFrame([(html,), (html,)], "h string"), "h", "promo", "2026-05-01")
    assert [(r.title, r.article_url, str(r.article_date)) for r in got.orderBy("article_url").collect()] == [("A & B", "/a", "2026-04-02"), ("C", "/b", "None")]


def test_other_layouts(spark):
    h = '<h3 class="element-title x"><a href="/p">One</a></h3><span class="date d-inline-block">Apr 20, 2026 10:15am</span><h3 class="element-title">none</h3><a href="/q">no</a>'
    got = readers.news_cards(spark.createDataFrame([(h,)], "h string"), "h", "heading", "2026-05-01", "https://n.example")
    assert [(r.title, r.article_url, str(r.article_date)) for r in got.collect()] == [("One", "https://n.example/p", "2026-04-20")]
    h = '<div class="box epn_item"><h3><a href="u" title="Clean &amp; short">x</a></h3><div class="epn_time">3 days ago</div></div><div class="epn_item"><h3><a href="v"><b>Two</b></a></h3></div>'
    got = readers.news_cards(spark.createDataFrame([(h,)], "h string"), "h", "relative", "2026-05-10")
    assert sorted((r.title, r.article_url, str(r.article_date)) for r in got.collect()) == [("Clean & short", "u", "2026-05-07"), ("Two", "v", "None")]


def test_job_cards(spark):
    card = '<div class="base-card x"><a class="base-card__full-link" href="/jobs/view/cra-1?t=2">x</a><h3 class="base-search-card__title"> CRA &amp; co </h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4><span class="job-search-card__location">Boston</span><time datetime="2026-04-01">1 month ago</time></div>'
    pages = spark.createDataFrame([(f"<ul><li>{card}</li><li>no title</li></ul>",), ('<div class="base-card"><h3>Lead</h3><time>2 weeks ago</time></div>',)], "h string")
    got = sorted(map(tuple, readers.job_cards(pages, "h", "2026-05-01", "https://j.example", "Given").collect()))
    assert got == [("CRA & co", "Acme", "Boston", "https://j.example/jobs/view/cra-1", 30), ("Lead", "Given", "", "", 14)]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    counted = lambda: sinks.append_new(df, p, ["k"], ["v"], n_a=F.count_if(c("v") == "a"))
    assert counted() == {"n_new": 2, "n_a": 1} and counted() == {"n_new": 0, "n_a": 0}
    sinks.replace(spark.read.parquet(p).filter("k = 2"), p)
    assert rows(spark.read.parquet(p)) == [(2, "c")]
    log = str(tmp_path / "log")
    sinks.log_run(spark, log, "trials", "2026-01-01", "2026-01-02", "ok", 3)
    sinks.log_run(spark, log, "trials", "2026-01-02", "2026-01-03", "failed", 0)
    assert sinks.last_runs(spark, log).first().status == "failed"


def test_streams(spark, tmp_path):
    jobs, table, folder = tmp_path / "in", str(tmp_path / "jobs"), str(tmp_path / "dir")
    jobs.mkdir()
    spark.createDataFrame([("Acme Inc.", "10", "a.com")], "name string, size string, domain string").write.parquet(folder)
    spark.createDataFrame([("chef",)], "job_title_lower string").write.parquet(str(tmp_path / "blocked"))
    line = lambda t, co, u: json.dumps({"job_title": t, "company_name": co, "job_url": u, "received_at": "2026-01-01T00:00:00Z"})
    (jobs / "1.json").write_text("\n".join([line("Biostatistician", "ACME", "http://j/1?x=1"), line("Chef (m)", "Acme", "http://j/2"), line("QA", "Beta", "http://j/3"), line("QA", "Beta", "http://j/3?y=2")]))
    run = lambda: ingest.ingest_jobs(spark, str(jobs), table, folder, str(tmp_path / "cp"), blocked=str(tmp_path / "blocked")).awaitTermination()
    run()
    got = {r.job_url: (r.matched_name, r.specialty) for r in spark.read.parquet(table).collect()}
    assert got == {"http://j/1": ("Acme Inc.", ["Biostatistics"]), "http://j/3": (None, ["Other"])}
    (jobs / "2.json").write_text(line("QA", "Beta", "http://j/3?again"))
    run()
    assert spark.read.parquet(table).count() == 2
    companies = tmp_path / "companies"
    companies.mkdir()
    (companies / "1.json").write_text(json.dumps({"name": "Beta LLC", "company_size": "5", "domain": "b.com", "received_at": "2026-01-01T00:00:00Z"}))
    ingest.ingest_companies(spark, str(companies), folder, table, str(tmp_path / "cp2")).awaitTermination()
    assert {r.job_url: r.matched_name for r in spark.read.parquet(table).collect()} == {"http://j/1": "Acme Inc.", "http://j/3": "Beta LLC"}
