"""Push sources, windows and stored tables on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import tables as O
from tidewater.sources import buckets, readers, rollup, schemas, sinks
from tidewater.streaming import ingest


def lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_contact_stream(spark, tmp_path):
    table, folder = str(tmp_path / "contacts"), tmp_path / "in"
    kinds = "linkedin_url string, original_title string, original_company string, current_title string, current_company string, current_location string, job_history array<struct<role: string, company: string>>, last_change_type string, last_enrichment_date date"
    start = spark.createDataFrame([("u1", "CRA", "Old", "CRA", "Old", "X", [], None, None), ("u2", "A", "B", "A", "B", None, [], None, None)], kinds)
    buckets.create(start, table, ingest.contact_key())
    lines(folder, "1.json", [{"linkedin_url": "U1", "title": t, "company": "New", "location": "X", "received_at": f"2026-01-0{i}T00:00:00Z"} for i, t in enumerate(("Lead", "Head"), 1)])
    run = lambda: ingest.ingest_contacts(spark, str(folder), table, str(tmp_path / "cp"), "2026-02-01").awaitTermination()
    run()
    got = {r.linkedin_url: r for r in spark.read.parquet(table).collect()}
    assert (got["u1"].original_title, got["u1"].current_title, got["u1"].current_company, len(got["u1"].job_history)) == ("Lead", "Head", "New", 1)
    assert got["u2"].last_enrichment_date is None and len(got) == 2
    run()
    assert spark.read.parquet(table).count() == 2
    # a crash before the commit of the batch: it comes again
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    run()
    assert {r.linkedin_url: r for r in spark.read.parquet(table).collect()} == got


def test_competitor_and_lead_streams(spark, tmp_path):
    jobs, people = tmp_path / "jobs", tmp_path / "people"
    job = lambda t, u: {"job_title": t, "company_name": "Kelly", "job_url": u, "received_at": "2026-01-01T00:00:00Z"}
    lines(jobs, "1.json", [job("CRA", "http://j/1?a"), job("CRA", "http://j/1?b"), job("", "http://j/2"), job("QA", "")])
    ingest.ingest_competitor_jobs(spark, str(jobs), str(tmp_path / "t"), str(tmp_path / "cp1")).awaitTermination()
    assert [r.job_url for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["http://j/1"]
    person = lambda n, co, u=None: {"full_name": n, "company_name": co, "job_title": "Biostatistician", "linkedin_url": u, "received_at": "2026-01-01T00:00:00Z"}
    lines(people, "1.json", [person("Kim", "Acme", "http://x/Kim/"), person("Kim L.", "Acme", "http://x/kim"), person("Lee", "Acme"), person("lee ", "ACME"), person("Ann", ""), person("", "Acme")])
    ingest.ingest_lead_contacts(spark, str(people), str(tmp_path / "p"), str(tmp_path / "cp2")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "p")).collect()
    assert sorted(r.contact_key for r in got) == ["http://x/kim", "lee|acme"] and all(r.specialty == ["Biostatistics"] for r in got)


def test_overrides_hold_from_the_next_batch(spark, tmp_path):
    jobs, table, directory, over = tmp_path / "in", str(tmp_path / "jobs"), str(tmp_path / "dir"), str(tmp_path / "over")
    spark.createDataFrame([("Acme Inc.", "10", "a.com")], "name string, size string, domain string").write.parquet(directory)
    kinds = "job_title_lower string, specialty array<string>"
    spark.createDataFrame([], kinds).write.parquet(over)
    job = lambda u: {"job_title": "Wizard", "company_name": "Acme", "job_url": u, "received_at": "2026-01-01T00:00:00Z"}
    run = lambda: ingest.ingest_jobs(spark, str(jobs), table, directory, str(tmp_path / "cp"), overrides=over).awaitTermination()
    lines(jobs, "1.json", [job("http://j/1")])
    run()
    spark.createDataFrame([("wizard", ["Biometrics"])], kinds).write.mode("overwrite").parquet(over)
    lines(jobs, "2.json", [job("http://j/2")])
    run()
    assert {r.job_url: r.specialty for r in spark.read.parquet(table).collect()} == {"http://j/1": ["Other"], "http://j/2": ["Biometrics"]}


def test_sessions(spark):
    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:20:00"), ("a", "2026-01-01 02:00:00"), ("b", "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted((r.k, r.n) for r in ingest.sessions(df, "at", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("left", ["both", "old", "half"])
def test_recover(spark, tmp_path, left):
    """What a crash leaves between the steps of replace()."""
    p = str(tmp_path / "t")
    table = lambda v: spark.createDataFrame([(v,)], "v int")
    table(1).write.parquet(p + ".old")
    if left == "both":
        table(2).write.parquet(p + ".new")
    if left == "half":
        (tmp_path / "t.new").mkdir()
    sinks.recover(spark, p)
    assert spark.read.parquet(p).first().v == (2 if left == "both" else 1)
    sinks.replace(spark.read.parquet(p).selectExpr("v + 10 AS v"), p)
    assert spark.read.parquet(p).first().v in (11, 12) and not (tmp_path / "t.old").exists()


def test_refresh(spark, tmp_path):
    p = str(tmp_path / "rollup")
    for n in (3, 5):
        assert sinks.refresh(spark.range(n).withColumnRenamed("id", "x"), p).count() == n


def test_csv_and_grants(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿person_name,linkedin_url,original_title,original_company,email,phone\n Kim , http://x ,, Acme ,,\n", encoding="utf-8")
    r = readers.contacts_csv(spark, str(tmp_path / "c.csv")).first()
    assert (r.person_name, r.linkedin_url, r.original_title, r.original_company) == ("Kim", "http://x", None, "Acme")
    grant = {"appl_id": "7", "project_title": "T", "organization": {"org_name": "Acme"}, "award_amount": None, "total_cost": 12.5, "award_notice_date": "2026-01-05T00:00:00", "date_added": "2026-01-06", "activity_code": "R43", "fiscal_year": 2026}
    (tmp_path / "g.json").write_text(json.dumps({"results": [grant, {**grant, "appl_id": "8", "activity_code": "R01"}, {**grant, "appl_id": "9", "award_notice_date": "2025-01-05"}]}))
    g = readers.grants(spark, str(tmp_path / "g.json"))
    assert [r.appl_id for r in readers.recent_grants(g, "2026-02-01", 90, ("R43",), years=(2026,)).collect()] == ["7"] and g.first().award_amount == 12.5


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 7).alias("k"))
    got = O.ranked(df, [F.col("k").desc(), F.col("id")]).collect()
    want = sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 1001))


def test_schema_of_leads():
    assert "full_name" in schemas.LEAD_CONTACTS


def files(table):
    return {str(f.relative_to(table)): f.stat().st_mtime_ns for f in table.rglob("*.parquet")}


def test_an_update_rewrites_touched_buckets_only(spark, tmp_path):
    table = tmp_path / "t"
    df = spark.range(500).select(F.concat(F.lit("u"), "id").alias("k"), F.lit(0).alias("v"))
    buckets.create(df, str(table), F.col("k"), 16)
    before = files(table)
    keys = spark.createDataFrame([("u1",), ("u2",), ("nobody",)], "k string")
    change = lambda rows: rows.withColumn("v", F.when(F.col("k").isin("u1", "u2"), F.col("v") + 1).otherwise(F.col("v")))
    run = lambda n: buckets.update(spark, str(table), keys, F.col("k"), change, ("q", n), 16)
    hit = run(0)
    after = files(table)
    assert 1 <= len(hit) <= 3
    for f, at in before.items():
        assert (f in after and after[f] == at) == (int(f.split("/")[0].removeprefix("bucket=")) not in hit)
    # a replay changes nothing, the next batch does
    assert run(0) == [] and files(table) == after
    assert run(1) == hit
    got = {r.k: r.v for r in spark.read.parquet(str(table)).collect()}
    assert len(got) == 500 and {k for k, v in got.items() if v} == {"u1", "u2"} and got["u1"] == 2


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_crash_inside_an_update(spark, tmp_path, monkeypatch, step):
    """At the first write, after it, and after the second: the batch comes again and
    is applied once."""
    table = str(tmp_path / "t")
    buckets.create(spark.range(50).select("id", F.lit(0).alias("v")), table, F.col("id"), 4)
    change = lambda rows: rows.withColumn("v", F.col("v") + 1)
    run = lambda: buckets.update(spark, table, spark.range(50), F.col("id"), change, ("q", 7), 4)
    real, calls = buckets._write, []

    def failing(df, path, mode, *how):
        calls.append(path)
        if step == len(calls) == 1:
            (tmp_path / "t.q-7").mkdir()
            raise OSError
        real(df, path, mode, *how)
        if len(calls) == step - 1 or step == len(calls) == 2:
            raise OSError

    monkeypatch.setattr(buckets, "_write", failing)
    with pytest.raises(OSError):
        run()
    monkeypatch.setattr(buckets, "_write", real)
    run()
    assert {(r.v, r["count"]) for r in spark.read.parquet(table).groupBy("v").count().collect()} == {(1, 50)}
    assert not (tmp_path / "t.q-7").exists() and run() == []


def test_rollup_of_changes(spark, tmp_path):
    path, keys = str(tmp_path / "r"), ["k"]
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    now = lambda: sorted(tuple(r) for r in rollup.current(spark, path, keys).collect())
    full = lambda rows: sorted((r.k, r["count"]) for r in rows.groupBy("k").count().collect())
    with pytest.raises(ValueError):
        now()
    rollup.add_batch(path, 0, keys, df.filter("id < 40"))
    rollup.add_batch(path, 1, keys, df.filter("id >= 40"))
    assert now() == full(df)
    rollup.add_batch(path, 1, keys, df.filter("id >= 40"))
    assert now() == full(df)
    rollup.add_batch(path, 2, keys, df.limit(0), df.filter("k = 3"))
    assert now() == full(df.filter("k <> 3"))
    rollup.compact(spark, path, keys, 1)
    assert now() == full(df.filter("k <> 3")) and len(list((tmp_path / "r" / "batches").iterdir())) == 1
    # a batch of the base that comes again, a half-written base and a half-written batch
    rollup.add_batch(path, 1, keys, df)
    (tmp_path / "r" / "base" / "upto=9").mkdir()
    (tmp_path / "r" / "batches" / "batch=5").mkdir()
    assert now() == full(df.filter("k <> 3"))
    rollup.compact(spark, path, keys, 4)
    rollup.compact(spark, path, keys, 4)
    assert now() == full(df.filter("k <> 3"))


def test_companies_rewrite_the_buckets_of_their_names(spark, tmp_path):
    jobs, table, directory, companies = tmp_path / "in", tmp_path / "jobs", str(tmp_path / "dir"), tmp_path / "companies"
    spark.createDataFrame([("Acme Inc.", "10", "a.com")], "name string, size string, domain string").write.parquet(directory)
    lines(jobs, "1.json", [{"job_title": "QA", "company_name": n, "job_url": f"http://j/{i}", "received_at": "2026-01-01T00:00:00Z"} for i, n in enumerate([*[f"Firm{x} Labs" for x in "abcdefghij"], "Beta Gamma Inc", "Gamma Beta"])])
    ingest.ingest_jobs(spark, str(jobs), str(table), directory, str(tmp_path / "cp")).awaitTermination()
    before = files(table)
    lines(companies, "1.json", [{"name": "Beta Gamma LLC", "company_size": "5", "domain": "b.com", "received_at": "2026-01-01T00:00:00Z"}])
    run = lambda: ingest.ingest_companies(spark, str(companies), directory, str(table), str(tmp_path / "cp2")).awaitTermination()
    run()
    got = {r.company_name: r.matched_via for r in spark.read.parquet(str(table)).collect()}
    assert (got["Beta Gamma Inc"], got["Gamma Beta"], got["Firma Labs"]) == ("exact_name", "keyword", None) and len(got) == 12
    after = files(table)
    assert 0 < len(before.items() & after.items()) < len(before)
    for f in (tmp_path / "cp2" / "commits").iterdir():
        f.unlink()
    run()
    assert files(table) == after
