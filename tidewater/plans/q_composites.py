"""The pages' composite queries, over the driver tables as matched records. Their
SQL is written out on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import feeds
from tidewater.plans.registry import query
from tidewater.plans.views import cte, view

c = F.col
_NEWS = ("news_a", "news_b", "news_c")
_LEADS = ("leads_a", "leads_b", "leads_c", "leads_d")
_MATCHED = ("trials", "funding", "jobs", "eight_k", "s1")
#: A past client's name or match, for the large companies that stay.
_KNOWN = ", known AS (SELECT lower(name) AS k FROM past_clients WHERE is_active AND name <> '' UNION SELECT lower(matched_name) FROM past_clients WHERE is_active AND matched_name <> '')"
_STRICT = "(coalesce(company_size, '') <> '10,001+ employees' OR lower(matched_name) IN (SELECT k FROM known))"
_BOTH = "(coalesce(company_size, '') NOT IN ('10,001+ employees', '10,001+') OR lower(matched_name) IN (SELECT k FROM known))"
_DEAL = "list_contains(string_split(items, ','), '1.01')"
_AS_OF = "2024-01-29 03:00:00"


def _tables(spark, sf, *roles):
    out = {r: view(spark, sf, r) for r in roles}
    for r, t in out.items():
        if r == "eight_k":
            out[r] = t.withColumn("items", F.split("items", ","))
        if r in _NEWS:
            out[r] = t.withColumn("matched_names", F.split("names", "[|]")).drop("names")
    if "past_clients" in out:
        out["clients"] = out["past_clients"]
    return out


_COMPANY = "Zeta 23"


@query("L2_company_detail", cte(*_MATCHED, *_NEWS, "buyers", "candidates", "past_clients") + f"""
SELECT 'trials' AS source, id, title, created_at AS at FROM trials WHERE matched_name = '{_COMPANY}' UNION ALL SELECT 'funding', id, title, created_at FROM funding WHERE matched_name = '{_COMPANY}'
UNION ALL SELECT 'jobs', id, title, created_at FROM jobs WHERE matched_name = '{_COMPANY}' UNION ALL SELECT 'eight_k', id, NULL, created_at FROM eight_k WHERE matched_name = '{_COMPANY}' AND {_DEAL}
UNION ALL SELECT 's1', id, NULL, created_at FROM s1 WHERE matched_name = '{_COMPANY}'
UNION ALL SELECT 'news_a', id, title, created_at FROM news_a WHERE list_contains(string_split(names, '|'), '{_COMPANY}') UNION ALL SELECT 'news_b', id, title, created_at FROM news_b WHERE list_contains(string_split(names, '|'), '{_COMPANY}')
UNION ALL SELECT 'news_c', id, title, created_at FROM news_c WHERE list_contains(string_split(names, '|'), '{_COMPANY}')
UNION ALL SELECT 'buyers', id, NULL, NULL FROM buyers WHERE current_company ILIKE '{_COMPANY}' UNION ALL SELECT 'candidates', id, NULL, NULL FROM candidates WHERE current_company ILIKE '{_COMPANY}'
UNION ALL SELECT 'clients', id, NULL, NULL FROM past_clients WHERE is_active""")
def l2(spark, sf):
    return feeds.company_detail(_COMPANY, _tables(spark, sf, *_MATCHED, *_NEWS, "buyers", "candidates", "past_clients"))


@query("L3_leads_page", cte(*_MATCHED, *_NEWS, "contacts", "leads_d") + f""", f AS (
SELECT 'trials' AS feed, id, matched_name AS company, created_at FROM trials WHERE matched_name IN (SELECT name FROM leads_d)
UNION ALL SELECT 'filings', id, matched_name, created_at FROM eight_k WHERE {_DEAL} AND matched_name IN (SELECT name FROM leads_d) UNION ALL SELECT 'filings', id, matched_name, created_at FROM s1 WHERE matched_name IN (SELECT name FROM leads_d)
UNION ALL SELECT 'funding', id, matched_name, created_at FROM funding WHERE matched_name IN (SELECT name FROM leads_d) UNION ALL SELECT 'jobs', id, matched_name, created_at FROM jobs WHERE matched_name IN (SELECT name FROM leads_d)
UNION ALL SELECT 'news', id, min(company), created_at FROM (SELECT id, unnest(string_split(names, '|')) AS company, created_at FROM (SELECT * FROM news_a UNION ALL SELECT * FROM news_b UNION ALL SELECT * FROM news_c)) WHERE company IN (SELECT name FROM leads_d) GROUP BY id, created_at
UNION ALL SELECT 'contacts', id, company_name, created_at FROM contacts WHERE lower(company_name) IN (SELECT lower(name) FROM leads_d))
SELECT *, created_at >= TIMESTAMP '2024-01-21 05:00:00' AS is_new FROM f""")
def l3(spark, sf):
    return feeds.leads_page(view(spark, sf, "leads_d"), _tables(spark, sf, *_MATCHED, *_NEWS, "contacts"), F.lit(_AS_OF).cast("timestamp"))


@query("L3_E12_new_counts", cte("trials", "jobs", "leads_d") + "SELECT feed, count(*) AS n, count(*) FILTER (created_at >= TIMESTAMP '2024-01-21 05:00:00') AS n_new FROM (SELECT 'trials' AS feed, * FROM trials UNION ALL SELECT 'jobs', * FROM jobs) WHERE matched_name IN (SELECT name FROM leads_d) GROUP BY feed")
def l3b(spark, sf):
    rows = feeds.leads_page(view(spark, sf, "leads_d"), _tables(spark, sf, *_MATCHED, *_NEWS, "contacts"), F.lit(_AS_OF).cast("timestamp"))
    return feeds.new_counts(rows.filter("feed IN ('trials', 'jobs')"))


@query("L4_crm_summary", cte("accounts", *_LEADS) + """, n AS (SELECT 'a' AS person, count(*) AS total_targets FROM leads_a UNION ALL SELECT 'b', count(*) FROM leads_b UNION ALL SELECT 'c', count(*) FROM leads_c UNION ALL SELECT 'd', count(*) FROM leads_d)
SELECT person, any_value(total_targets) AS total_targets, count(*) FILTER (development_stage = 'Prospecting') AS prospecting, count(*) FILTER (development_stage = 'Engaged') AS engaged, count(*) FILTER (development_stage = 'Active') AS active,
count(*) FILTER (development_stage = 'MSA Sent') AS msa_sent, count(*) FILTER (development_stage = 'MSA Signed') AS msa_signed, count(*) FILTER (momentum = 'Drive') AS drive, count(*) FILTER (momentum = 'Neutral') AS neutral,
count(*) FILTER (momentum = 'Reverse') AS reverse, count(*) FILTER (momentum = 'Park') AS park FROM n LEFT JOIN accounts ON leads_page = person GROUP BY person""")
def l4(spark, sf):
    return feeds.crm_summary(view(spark, sf, "accounts"), {p[-1]: view(spark, sf, p) for p in _LEADS})


@query("L5_trials_feed", cte("trials", "past_clients") + _KNOWN + f" SELECT id, matched_name, company_size FROM trials WHERE {_STRICT}")
def l5a(spark, sf):
    return feeds.trials_feed(view(spark, sf, "trials"), view(spark, sf, "past_clients")).select("id", "matched_name", "company_size")


@query("L5_filings_feed", cte("eight_k", "s1", "past_clients") + _KNOWN + f" SELECT id, '8-K' AS form, coalesce(nullif(agreement_type, ''), 'Other') AS transaction FROM eight_k WHERE {_DEAL} AND {_STRICT} UNION ALL SELECT id, 'S-1', 'IPO' FROM s1 WHERE {_STRICT}")
def l5b(spark, sf):
    t = _tables(spark, sf, "eight_k", "s1", "past_clients")
    return feeds.filings_feed(t["eight_k"], t["s1"], t["clients"]).select("id", "form", "transaction")


@query("L5_funding_feed", cte("funding", "past_clients") + _KNOWN + f" SELECT id, matched_name FROM funding WHERE matched_name <> '' AND {_BOTH}")
def l5c(spark, sf):
    return feeds.funding_feed(view(spark, sf, "funding"), view(spark, sf, "past_clients")).select("id", "matched_name")


@query("L5_jobs_feed", cte("jobs", "past_clients") + _KNOWN + f" SELECT id, matched_name FROM jobs WHERE {_BOTH}")
def l5d(spark, sf):
    return feeds.jobs_feed(view(spark, sf, "jobs"), view(spark, sf, "past_clients")).select("id", "matched_name")


@query("L7_news_feed", cte("news") + "SELECT source, id, regexp_extract(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})', 3)::INT AS day, title FROM news")
def l7(spark, sf):
    return view(spark, sf, "news").select("source", "id", F.regexp_extract("url", r"/(\d{4})/(\d{1,2})/(\d{1,2})", 3).cast("int").alias("day"), "title")


@query("L7_H2_news_union", cte(*_NEWS) + "SELECT 'news_a' AS source, id, title FROM news_a UNION ALL SELECT 'news_b', id, title FROM news_b UNION ALL SELECT 'news_c', id, title FROM news_c")
def l7b(spark, sf):
    return feeds.news_feed(_tables(spark, sf, *_NEWS)).select("source", "id", "title")


@query("L8_badge_counts", cte(*_MATCHED, "competitor_jobs", *_NEWS, "buyers", "candidates", "past_clients", *_LEADS) + _KNOWN + f""", d AS (SELECT matched_name, company_size FROM eight_k WHERE {_DEAL} UNION ALL SELECT matched_name, company_size FROM s1),
p AS (SELECT 'buyers' AS t, * FROM buyers UNION ALL SELECT 'candidates', * FROM candidates),
m AS (SELECT t, lower(trim(coalesce(original_company, ''))) <> lower(trim(coalesce(current_company, ''))) OR lower(trim(coalesce(original_title, ''))) <> lower(trim(coalesce(current_title, ''))) AS moved FROM p)
SELECT 'leads_a' AS badge, (SELECT count(*) FROM leads_a) AS n UNION ALL SELECT 'leads_b', (SELECT count(*) FROM leads_b) UNION ALL SELECT 'leads_c', (SELECT count(*) FROM leads_c) UNION ALL SELECT 'leads_d', (SELECT count(*) FROM leads_d)
UNION ALL SELECT 'trials', count(*) FROM trials WHERE {_BOTH} UNION ALL SELECT 'deals', count(*) FROM d WHERE {_BOTH} UNION ALL SELECT 'funding', count(*) FROM funding WHERE matched_name <> '' AND {_BOTH} UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE {_BOTH}
UNION ALL SELECT 'competitor_jobs', count(*) FROM competitor_jobs UNION ALL SELECT 'news', count(*) FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT t, count(*) FILTER (moved) FROM m GROUP BY t""")
def l8(spark, sf):
    t = _tables(spark, sf, *_MATCHED, "competitor_jobs", *_NEWS, "buyers", "candidates", "past_clients")
    return feeds.badge_counts(t, {p[-1]: view(spark, sf, p) for p in _LEADS})


@query("L9_active_signals", cte("signals", "directory") + "SELECT s.id, s.signal_type, s.priority_score, d.name AS company_name, d.industry AS company_industry FROM signals s LEFT JOIN directory d ON d.id = s.company_id WHERE status IN ('new', 'carried_forward', 'claimed', 'contacted')")
def l9(spark, sf):
    return feeds.active_signals(view(spark, sf, "signals"), view(spark, sf, "directory")).select("id", "signal_type", "priority_score", "company_name", "company_industry")


_CLAIMED = "CASE id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Kim' END"


@query("L9_E9_signal_stats", cte("signals") + f"SELECT count(*) AS total_active, count(*) FILTER (CAST(first_detected_at AS DATE) = DATE '2024-01-05') AS new_today, count(*) FILTER (trim({_CLAIMED}) <> '') AS claimed FROM signals WHERE status <> 'dismissed'")
def l9b(spark, sf):
    return feeds.signal_stats(view(spark, sf, "signals").withColumn("claimed_by", F.expr(_CLAIMED)), F.lit("2024-01-05").cast("date"))


@query("L9_I65_signal_patch", cte("signals") + f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'claimed' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN 'Lee' ELSE {_CLAIMED} END AS claimed_by,
CASE id % 6 WHEN 0 THEN 'a=1,claimed_at=now,claimed_by=Lee' WHEN 3 THEN 'a=1,rep_notes=x' WHEN 1 THEN 'a=1,dismissal_reason=r,dismissal_value=v' ELSE 'a=1,rep_notes=old' END AS detail FROM signals""")
def l9c(spark, sf):
    s = view(spark, sf, "signals").select("id", "status", F.expr(_CLAIMED).alias("claimed_by"), F.expr("CASE id % 6 WHEN 0 THEN map('a', '1') WHEN 1 THEN map('a', '1') ELSE map('a', '1', 'rep_notes', 'old') END").alias("detail"))
    none = F.lit(None).cast("string")
    p = s.filter("id % 3 = 0 OR id % 6 = 1").select(
        "id", F.expr("CASE WHEN id % 3 = 0 THEN 'claimed' END").alias("status"), F.expr("CASE WHEN id % 3 = 0 THEN 'Lee' END").alias("claimed_by"), F.expr("CASE WHEN id % 6 = 3 THEN 'x' END").alias("notes"),
        F.expr("CASE WHEN id % 6 = 1 THEN 'r' END").alias("dismissal_reason"), F.expr("CASE WHEN id % 6 = 1 THEN 'v' END").alias("dismissal_value"), none.alias("inferred_client"), F.expr("CASE WHEN id % 6 = 0 THEN 'now' END").alias("claimed_at"),
    )
    pairs = F.transform(F.array_sort(F.map_entries("detail")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return feeds.patch_signals(s, p).select("id", "status", "claimed_by", F.array_join(pairs, ",").alias("detail"))


@query("L10_contacts_summary", cte("buyers") + """SELECT count(*) AS total, max(DATE '2024-01-01' + (id % 28)::INT) AS last_enrichment_date, count(*) FILTER (lower(trim(coalesce(original_company, ''))) <> lower(trim(coalesce(current_company, '')))) AS company_changes,
count(*) FILTER (lower(trim(coalesce(original_title, ''))) <> lower(trim(coalesce(current_title, '')))) AS role_changes FROM buyers""")
def l10(spark, sf):
    return feeds.contacts_summary(view(spark, sf, "buyers").withColumn("last_enrichment_date", F.expr("date_add(DATE '2024-01-01', CAST(id % 28 AS INT))")))


@query("L11_submission_check", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'invalid_url' WHEN 1 THEN 'already_exists' ELSE 'accepted' END AS outcome, CASE WHEN p_partkey % 4 = 1 THEN 'Firm ' || p_partkey END AS company_name FROM part""")
def l11b(spark, sf):
    """Bad addresses, known ones in another case with slashes, longer and new ones."""
    url = "CASE p_partkey % 4 WHEN 0 THEN 'https://www.linkedin.com/in/' || p_partkey WHEN 1 THEN ' HTTPS://www.linkedin.com/company/Firm' || p_partkey || '/ ' WHEN 2 THEN 'https://www.linkedin.com/company/firm' || (p_partkey - 1) || 'x' ELSE 'https://www.linkedin.com/company/new' || p_partkey END"
    parts = view(spark, sf, "trials").sparkSession.read.parquet(f"{sf}/part.parquet")
    known = parts.filter("p_partkey % 4 = 1").selectExpr("'https://www.linkedin.com/company/firm' || p_partkey || '//' AS linkedin_url", "'Firm ' || p_partkey AS name")
    urls = parts.selectExpr("p_partkey AS id", f"{url} AS url")
    return urls.join(feeds.submission_checks(urls, known), "url").select("id", "outcome", "company_name")


@query("L12_news_names", cte("news_a") + "SELECT id, CASE id % 4 WHEN 0 THEN 'A|B' WHEN 1 THEN NULL ELSE names END AS names FROM news_a")
def l12(spark, sf):
    n = _tables(spark, sf, "news_a")["news_a"].select(c("id").alias("article_url"), "matched_names")
    new = n.filter("article_url % 4 < 2").select("article_url", F.when(c("article_url") % 4 == 0, F.expr("array(' A', '', NULL, 'B ')")).otherwise(F.expr("array(' ')")).alias("company_names"))
    return feeds.assign_news(n, new).select(c("article_url").alias("id"), F.array_join("matched_names", "|").alias("names"))


@query("L12_alternate_upsert", """SELECT 'alt ' || s_suppkey AS alternate_name, CASE WHEN s_suppkey % 3 = 0 THEN 'New ' || s_suppkey ELSE 'Old ' || s_suppkey END AS directory_name, CASE WHEN s_suppkey % 3 = 0 THEN 'news_page_entry' ELSE 'exact_name' END AS matched_via FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0""")
def l12b(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    old = s.filter("s_suppkey % 2 = 0").selectExpr("'alt ' || s_suppkey AS alternate_name", "'Old ' || s_suppkey AS directory_name", "'exact_name' AS matched_via")
    new = s.filter("s_suppkey % 3 <> 2").selectExpr("CASE WHEN s_suppkey % 3 = 0 THEN ' alt ' || s_suppkey || ' ' ELSE '  ' END AS alternate_name", "'New ' || s_suppkey AS directory_name")
    twice = new.unionByName(new.withColumn("directory_name", F.concat("directory_name", F.lit(" later"))))
    return feeds.upsert_alternates(old, twice)
