"""Saved pages, ragged files, shuffles, phrases and the size check on small tables."""

import json

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import tables as O
from tidewater.plans import upkeep
from tidewater.sources import readers

c = F.col


def test_only_pages_in_range_are_opened(spark, tmp_path):
    """A folder out of range holds what can't be read."""
    hit = lambda i, day: {"_source": {"ciks": ["1"], "adsh": i, "display_names": ["Acme (CIK 1)"], "file_date": day, "items": []}}
    for form, chunk, days in (("8-K", "2024-01-01", ("2024-01-02", "2024-01-07")), ("8-K", "2024-01-08", ("2024-01-09",)), ("S-1", "2024-01-08", ("2024-01-09",)), ("8-K", "2023-05-01", ("2023-05-02",))):
        folder = tmp_path / f"form={form}" / f"chunk={chunk}"
        folder.mkdir(parents=True)
        for day in days:
            (folder / f"{day}.json").write_text(json.dumps({"hits": {"hits": [hit(f"{form} {day}", day)]}}))
    df = readers.filings_of(spark, str(tmp_path), ("8-K",), "2024-01-10", 5)
    assert sorted(r.accession_number for r in df.collect()) == ["8-K 2024-01-07", "8-K 2024-01-09"]
    opened = {r[0].split("/form=")[1].split("/")[1] for r in df.select(F.input_file_name()).collect()}
    assert opened == {"chunk=2024-01-01", "chunk=2024-01-08"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "form" in filters and "chunk" in filters


def test_nothing_of_a_ragged_file_is_lost(spark, tmp_path):
    head = "Name,Primary Industry,Size,Type,Location,Country,Domain,LinkedIn URL\n"
    body = ' Acme , Bio,11-50,Private,Boston,US,a.com,http://x/\n,Bio,1,P,B,US,b.com,u\nBeta,Bio,11\nGamma,Bio,1,P,B,US,g.com,u,extra\n\n"Del""ta, Inc",Bio,1,P,B,US,d.com,v\nACME,Bio,5,P,B,US,z.com,http://x\n'
    (tmp_path / "c.csv").write_text(head + body)
    good, bad = readers.checked_directory_csv(spark, str(tmp_path))
    assert sorted((r.name, r.domain, r.company_size) for r in good.collect()) == [("Acme", "a.com", "11-50"), ("Beta", None, "11"), ('Del"ta, Inc', "d.com", "1"), ("Gamma", "g.com", "1")]
    assert sorted((r.reason, r.record[:5]) for r in bad.collect()) == [("no name", ",Bio,"), ("ragged", "Beta,"), ("ragged", "Gamma")]
    assert bad.select("reason").count() == 3 and readers.directory_csv(spark, str(tmp_path)).columns == good.columns


def test_shuffle_is_fixed_by_its_seed(spark):
    df = spark.range(200).select((c("id") % 190).alias("k"), "id")
    places = lambda d, seed: sorted((r.k, r["rank"]) for r in O.shuffled(d, ["k"], seed).collect())
    one = places(df, "a")
    assert one == places(df.repartition(7), "a") and one != places(df, "b")
    assert sorted(r for _, r in one) == list(range(1, 201)) and one != sorted(one, key=lambda x: x[1])


def test_update_ids(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "id int, v string, n int")
    out = O.update_ids(df, spark.createDataFrame([(2,), (2,), (None,)], "id int"), "id", v=F.concat("v", F.lit("!")))
    assert out.columns == df.columns and sorted((r.v, r.n) for r in out.collect()) == [("a", 5), ("b!", 6), ("c", 7)]


def test_phrases(spark):
    df = spark.createDataFrame([(1, "The Merger and acquisition"), (2, "mergers and acquisition"), (3, "acquires by a definitive\n agreement"), (4, None)], "id int, t string")
    got = {r.id: (r.a, r.b) for r in df.select("id", T.has_phrases(c("t"), "acquisition", "merger").alias("a"), T.has_phrases(c("t"), "acquires", "definitive agreement").alias("b")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True), 4: (None, None)}


def test_size_check(spark):
    page = lambda n, size, more="": f"<title>{n} | P</title>{more}" + (f'jobSearchUrl":1,employeeCountRange{{start":{size}' if size else "") + "x" * 500
    companies = spark.createDataFrame([(1, "Big Co"), (2, "Small Co"), (3, "Client Co"), (4, "Unused Co"), (5, "Other Co"), (6, "Was Big"), (7, "big co ")], "id int, name string")
    signals = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate([(1, "ma_transaction"), (1, "competitor_job_posting"), (2, "ma_transaction"), (3, "ma_transaction"), (4, "competitor_job_posting"), (5, "ma_transaction"), (None, "ma_transaction"), (7, "x")])], "id int, company_id int, signal_type string")
    excluded = spark.createDataFrame([("WAS BIG", 20000), ("Gone", 30000), ("still", 15000)], "name string, members int")
    pages = spark.createDataFrame([("Big Co", page("Big", 10001)), ("Small Co", page("Small", 51)), ("Client Co", page("Client", 10001)), ("Unused Co", page("Unused", 10001)), ("Other Co", page("Else", 10001)), ("Was Big", page("Was", 5001)), ("still", page("still", 10001)), ("Gone", page("Gone", 5, "authwall"))], "name string, html string")
    clients = spark.createDataFrame([("Client Co", 1, True)], "name string, rank int, is_active boolean")
    after, left, changes = upkeep.size_check(signals, companies, excluded, pages, clients)
    assert sorted((r.name, r.members) for r in after.collect()) == [("Big Co", 10001), ("Gone", 30000), ("still", 10001)]
    assert sorted(r.id for r in left.collect()) == [2, 3, 4, 5, 6]
    assert sorted((r.name, r.change) for r in changes.collect()) == [("Big Co", "excluded"), ("WAS BIG", "reinstated")]
