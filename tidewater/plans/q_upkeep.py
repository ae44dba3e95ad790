"""Saved pages read by selection, upkeep of lists, and plain helpers. Their SQL is
written out on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import dates as D
from tidewater.functions import rules as R
from tidewater.functions import scores as S
from tidewater.functions import text as T
from tidewater.operators import staging
from tidewater.operators import tables as O
from tidewater.plans import upkeep
from tidewater.plans.registry import query
from tidewater.plans.views import read
from tidewater.sources import readers

c = F.col


def _saved(df, by, rows, path):
    """Writes a service's pages, each with the rows of one folder's share."""
    pages = df.groupBy(*by, (F.xxhash64("row") % 4).alias("page")).agg(F.collect_list("row").alias("rows"))
    pages.select(rows, *by).repartition(*by).write.partitionBy(*by).json(path)
    return path


@query("A7_A8_filing_pages", """SELECT o_orderkey::VARCHAR AS accession_number, o_orderdate::DATE AS filing_date, CASE WHEN o_orderstatus = 'P' THEN 'S-1' ELSE '8-K' END AS form, 'Firm ' || o_custkey AS company_name, o_orderpriority AS item
FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate::DATE BETWEEN DATE '1998-02-02' AND DATE '1998-08-01' AND CASE WHEN o_orderstatus = 'P' THEN 'S-1' ELSE '8-K' END = '8-K'""")
def a7(spark, sf):
    """Saved in folders of form and month; only 8-K pages of 180 days are opened."""
    o = read(spark, sf, "orders").filter("o_orderstatus <> 'F'").withColumn("d", c("o_orderdate").cast("date"))
    hit = F.struct(F.array(c("o_custkey").cast("string")).alias("ciks"), c("o_orderkey").cast("string").alias("adsh"), F.array(F.concat(F.lit("Firm "), "o_custkey", F.lit(" (CIK 1)"))).alias("display_names"), c("d").cast("string").alias("file_date"), F.array("o_orderpriority").alias("items"))
    o = o.select(F.struct(hit.alias("_source")).alias("row"), F.when(c("o_orderstatus") == "P", "S-1").otherwise("8-K").alias("form"), F.trunc("d", "month").alias("chunk"))
    path = _saved(o, ["form", "chunk"], F.struct(c("rows").alias("hits")).alias("hits"), staging.place(spark, "filings"))
    f = readers.filings_of(spark, path, ("8-K",), "1998-08-01", 180, chunk_days=31)
    return f.select("accession_number", "filing_date", "form", "company_name", T.nth(c("items"), 1).alias("item"))


@query("A7_phrase_search", """SELECT doc_id, regexp_matches(text, '(?i)(^|[^0-9A-Za-z])the([^0-9A-Za-z]|$)') AND regexp_matches(text, '(?i)(^|[^0-9A-Za-z])of\\s+the([^0-9A-Za-z]|$)') AS found, contains(lower(text), 'merger') AND contains(lower(text), 'acquisition') AS deal FROM documents""")
def a7b(spark, sf):
    deal = T.has_phrases(c("text"), *R.DEAL_SEARCHES[0])
    return read(spark, sf, "documents").select("doc_id", T.has_phrases(c("text"), "the", "of the").alias("found"), deal.alias("deal"))


_PART = "SELECT p_partkey AS k, DATE '2024-01-01' + (p_partkey % 90)::INT AS d, p_partkey % 5 = 0 AS abroad, p_partkey % 7 = 0 AS nowhere, p_name AS title FROM part"


@query("A2_A3_study_pages", f"WITH p AS ({_PART}) SELECT 'N' || k AS nct_id, d::VARCHAR AS last_update, title AS official_title, k % 3 = 0 AS starts_near FROM p WHERE d BETWEEN DATE '2024-02-01' AND DATE '2024-03-02' AND (nowhere OR NOT abroad)")
def a2(spark, sf):
    """Saved in folders of weeks; those of the last 30 days are opened. A place is in the
    United States, elsewhere, or not given; some studies start within the year."""
    p = read(spark, sf, "part").withColumn("d", F.expr("date_add(DATE'2024-01-01', CAST(p_partkey % 90 AS INT))"))
    start = F.when(c("p_partkey") % 3 == 0, "2024-06").otherwise("2021-05-05")
    place = F.when(c("p_partkey") % 7 == 0, F.expr("CAST(NULL AS array<struct<country:string>>)")).otherwise(F.array(F.struct(F.when(c("p_partkey") % 5 == 0, "France").otherwise("United States").alias("country"))))
    study = F.struct(F.struct(
        F.struct(F.concat(F.lit("N"), "p_partkey").alias("nctId"), c("p_name").alias("officialTitle")).alias("identificationModule"),
        F.struct(F.struct(c("d").cast("string").alias("date")).alias("lastUpdatePostDateStruct"), F.struct(start.alias("date")).alias("startDateStruct")).alias("statusModule"),
        F.struct(place.alias("locations")).alias("contactsLocationsModule"),
    ).alias("protocolSection"))
    rows = p.select(study.alias("row"), F.date_sub("d", (c("p_partkey") % 90 % 7).cast("int")).alias("chunk"))
    s = readers.studies_updated(spark, _saved(rows, ["chunk"], c("rows").alias("studies"), staging.place(spark, "studies")), "2024-03-02", 30)
    near = readers.starting_near(s, "2024-03-02").select("nct_id", F.lit(True).alias("n"))
    return s.join(near, "nct_id", "left").select("nct_id", "last_update", "official_title", F.coalesce("n", F.lit(False)).alias("starts_near"))


_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace({}, '(?is)<(script)[^>]*>.*?</script>|<(style)[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '\\s+', ' ', 'g'))"


@query("A9b_text_fallback", f"SELECT page_id, substr(CASE page_id % 3 WHEN 0 THEN {_PLAIN.format('html')} WHEN 1 THEN {_PLAIN.format('url')} ELSE '' END, 1, 5000) AS text FROM pages")
def a9(spark, sf):
    """A main document, one without text, or none; a .txt file, or none."""
    p = read(spark, sf, "pages")
    document = F.expr("CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<p> </p><script>x</script>' END")
    return p.select("page_id", readers.filing_text(document, F.expr("CASE WHEN page_id % 3 <> 2 THEN url END")).alias("text"))


@query("A18_ragged_rows", """WITH s AS (SELECT s_suppkey AS k FROM supplier), n AS (SELECT k, CASE WHEN k % 7 = 0 THEN NULL ELSE 'Firm ' || k // 2 END AS name, CASE WHEN k % 5 = 0 THEN NULL ELSE 'd' || k || '.com' END AS domain FROM s),
g AS (SELECT name, min(domain) AS domain FROM n WHERE name IS NOT NULL GROUP BY name)
SELECT 'company' AS kind, name, domain FROM g UNION ALL SELECT CASE WHEN name IS NULL THEN 'no name' ELSE 'ragged' END, NULL, NULL FROM n WHERE name IS NULL OR k % 5 = 0 OR k % 3 = 0""")
def a18(spark, sf):
    """Every fifth line ends before the domain, every third has a field too many, every
    seventh has no name; each name stands on two lines."""
    line = F.expr("concat(CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat('Firm ', s_suppkey DIV 2) END, ', Biotech ,11-50', CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat(',Private,Boston,US,d', s_suppkey, '.com, ') END, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN ',more' ELSE '' END)")
    path = staging.place(spark, "directory")
    read(spark, sf, "supplier").select(line.alias("value")).write.text(path)
    good, bad = readers.checked_directory_csv(spark, path, header=False)
    return good.select(F.lit("company").alias("kind"), "name", "domain").union(bad.select(c("reason").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("domain")))


@query("A24_update_ids", "SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) THEN 'seen' ELSE o_orderstatus END AS status, o_custkey FROM orders")
def a24(spark, sf):
    ids = read(spark, sf, "lineitem").filter("l_quantity = 50").select(c("l_orderkey").alias("id"))
    return O.update_ids(read(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), "o_custkey"), ids, "id", status=F.lit("seen"))


@query("F10_shuffle", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('night 1|' || o_orderkey), o_orderkey) AS rank FROM orders")
def f10(spark, sf):
    return O.shuffled(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "night 1")


@query("I61b_stored_phases", """WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'PHASE2' WHEN 1 THEN ' phase3 ' WHEN 2 THEN 'PRE_CLINICAL' WHEN 3 THEN 'pre-clinical' WHEN 4 THEN 'Phase 1/2' WHEN 5 THEN 'PHASE2/PHASE3' END AS raw, p_partkey % 5 AS n FROM part),
l AS (SELECT *, CASE id % 7 WHEN 0 THEN 'Phase 2' WHEN 1 THEN 'Phase 3' WHEN 2 THEN 'Pre-Clinical' WHEN 3 THEN 'Pre-Clinical' WHEN 4 THEN 'Phase 1/2' WHEN 5 THEN 'PHASE2/PHASE3' END AS label FROM p)
SELECT id, label, CASE label WHEN 'Phase 2' THEN 'Phase 1' WHEN 'Phase 3' THEN 'Phase 2' ELSE 'Pre-Clinical' END AS before, CASE n WHEN 0 THEN NULL WHEN 1 THEN 'Phase 2' WHEN 2 THEN 'Phase 1/Phase 2' WHEN 3 THEN 'NA' ELSE 'Phase 3/EARLY_PHASE1' END AS scanned FROM l""")
def i61b(spark, sf):
    raw = F.expr("CASE p_partkey % 7 WHEN 0 THEN 'PHASE2' WHEN 1 THEN ' phase3 ' WHEN 2 THEN 'PRE_CLINICAL' WHEN 3 THEN 'pre-clinical' WHEN 4 THEN 'Phase 1/2' WHEN 5 THEN 'PHASE2/PHASE3' END")
    phases = F.expr("CASE p_partkey % 5 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('PHASE2') WHEN 2 THEN array('PHASE1', 'phase2') WHEN 3 THEN array('NA') ELSE array('PHASE3', 'EARLY_PHASE1') END")
    p = read(spark, sf, "part").select(c("p_partkey").alias("id"), S.stored_phase(raw).alias("label"), S.scan_phase(phases).alias("scanned"))
    return p.select("id", "label", S.previous_phase(S.phase_of_label(c("label"))).alias("before"), "scanned")


@query("I40_dates", """WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d FROM orders) SELECT id, strftime(d, '%Y-%m-%d') AS day, strftime(d, '%m/%d/%Y') AS slashed, d - 90 AS before, d + 14 AS after,
(date_trunc('month', d) - INTERVAL 1 MONTH)::DATE + (day(d) - 1)::INT AS month_ago, (date_trunc('month', d) + INTERVAL 12 MONTH)::DATE + (day(d) - 1)::INT AS year_on FROM o""")
def i40(spark, sf):
    d = c("o_orderdate").cast("date")
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.date_format(d, "yyyy-MM-dd").alias("day"), D.slashed(d).alias("slashed"), D.days_from(d, -90).alias("before"), D.days_from(d, 14).alias("after"), D.months_from(d, -1).alias("month_ago"), D.months_from(d, 12).alias("year_on"))


# companies: customers; every third is on the list; pages tell sizes by the key
_COUNT = "CASE c_custkey % 4 WHEN 0 THEN 10001 WHEN 1 THEN 5001 WHEN 2 THEN 10001 END"


@query("L21_J6_size_check", """WITH s AS (SELECT event_id AS id, user_id % 400 AS company_id, event_type FROM events), used AS (SELECT DISTINCT company_id AS k FROM s WHERE event_type IN ('signup', 'purchase')),
co AS (SELECT c_custkey AS k, 'Firm ' || c_custkey || ' Labs' AS name FROM customer WHERE c_custkey < 400), ex AS (SELECT k, upper(name) AS name, 20000 AS members FROM co WHERE k % 3 = 0),
seen AS (SELECT k, name, CASE k % 4 WHEN 0 THEN 10001 WHEN 1 THEN 5001 WHEN 2 THEN 10001 END AS n, k % 10 = 8 AS client FROM co WHERE (k IN (SELECT k FROM used) OR k % 3 = 0) AND k % 4 <> 3 AND k % 5 <> 1 AND k % 11 <> 5),
new AS (SELECT k, name FROM seen WHERE n = 10001 AND NOT client AND k % 3 <> 0), back AS (SELECT k, name FROM seen WHERE n = 5001 AND NOT (client AND n = 10001) AND k % 3 = 0)
SELECT 'excluded' AS part, name, members FROM (SELECT name, CASE WHEN k IN (SELECT k FROM seen WHERE n = 10001 AND NOT client) THEN 10001 ELSE members END AS members FROM ex WHERE k NOT IN (SELECT k FROM back) UNION ALL SELECT name, 10001 FROM new)
UNION ALL SELECT 'signals', NULL, count(*) FROM s WHERE company_id NOT IN (SELECT k FROM new)
UNION ALL SELECT 'change ' || x, NULL, count(*) FROM (SELECT 'excluded' AS x FROM new UNION ALL SELECT 'reinstated' FROM back) GROUP BY x""")
def l21(spark, sf):
    """Pages that are blocked (every fifth), of another company (every eleventh) or
    without a size tell nothing; past clients stay."""
    s = read(spark, sf, "events").select(c("event_id").alias("id"), (c("user_id") % 400).alias("company_id"), F.expr("CASE event_type WHEN 'signup' THEN 'clinical_trial_new_ind' WHEN 'purchase' THEN 'ma_transaction' ELSE 'competitor_job_posting' END").alias("signal_type"))
    co = read(spark, sf, "customer").filter("c_custkey < 400").withColumn("name", F.expr("'Firm ' || c_custkey || ' Labs'"))
    old = co.filter("c_custkey % 3 = 0").select(F.upper("name").alias("name"), F.lit(20000).alias("members"))
    html = F.concat(F.expr("'<title>' || CASE WHEN c_custkey % 11 = 5 THEN 'Other' ELSE name END || ' | Pages</title>'"), F.expr("CASE WHEN c_custkey % 5 = 1 THEN 'authwall' ELSE '' END"), F.expr(f"CASE WHEN c_custkey % 4 <> 3 THEN 'jobSearchUrl&quot;:1,employeeCountRange{{start&quot;:' || ({_COUNT}) ELSE '' END"), F.repeat(F.lit("<p>filler</p>"), 60))
    clients = co.filter("c_custkey % 10 = 8").select("name", c("c_custkey").cast("int").alias("rank"), F.lit(True).alias("is_active"))
    after, left, changes = upkeep.size_check(s, co.select(c("c_custkey").alias("id"), "name"), old, co.select("name", html.alias("html")), clients)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("members")).select(F.lit(name).alias("part"), F.lit(None).cast("string").alias("name"), "members")
    told = changes.groupBy("change").agg(F.count(F.lit(1)).alias("members")).select(F.concat(F.lit("change "), "change").alias("part"), F.lit(None).cast("string").alias("name"), "members")
    return after.select(F.lit("excluded").alias("part"), "name", c("members").cast("long")).union(n(left, "signals")).union(told)
