"""Agents and scans over the driver tables. Their SQL is written out on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import staging
from tidewater.operators.enrichment import Source, enrich_deals
from tidewater.plans import agents, scans
from tidewater.plans.registry import query
from tidewater.plans.views import cte, read, view
from tidewater.sources import readers

c = F.col

# studies: parts, with sponsors of six kinds
_SPONSOR = "CASE p_partkey % 6 WHEN 0 THEN 'Acme Bio ' || (p_partkey % 40) WHEN 1 THEN 'State University' WHEN 2 THEN 'Zeta Labs ' || (p_partkey % 9) WHEN 3 THEN 'Rho Labs' WHEN 4 THEN '' ELSE 'Gone Pharma' END"
_POSTED = "'2024-01-' || lpad((p_partkey % 28 + 1) || '', 2, '0')"
_IN_US, _CLASS = "p_partkey % 11 <> 0", "CASE WHEN p_partkey % 7 = 0 THEN 'OTHER' ELSE 'INDUSTRY' END"


def _studies(spark, sf):
    return read(spark, sf, "part").selectExpr(
        "'N' || p_partkey AS nct_id", f"{_SPONSOR} AS sponsor", f"{_CLASS} AS sponsor_class", f"{_IN_US} AS in_us", "CASE p_partkey % 4 WHEN 0 THEN array('PHASE1') WHEN 1 THEN array('PHASE2') WHEN 2 THEN array('PHASE1', 'PHASE2') ELSE array('PHASE3') END AS phases",
        "CASE WHEN p_partkey % 3 = 0 THEN array('M ' || p_partkey) ELSE CAST(array() AS array<string>) END AS mesh_terms", "p_name AS official_title", "'' AS brief_title", "CASE WHEN p_partkey % 2 = 0 THEN 'drug X' END AS intervention",
        f"{_POSTED} AS first_posted", "CAST(NULL AS STRING) AS last_update",
    )


@query("L16_trial_signals", f"""WITH s AS (SELECT p_partkey AS k, {_SPONSOR} AS company_name, CASE WHEN p_partkey % 3 = 0 THEN 'M ' || p_partkey ELSE p_name END || ' evaluating ' || CASE WHEN p_partkey % 2 = 0 THEN 'drug X' ELSE 'an investigational agent' END AS summary,
 p_partkey % 4 AS kind, CAST({_POSTED} AS DATE) AS posted FROM part WHERE {_IN_US} AND {_CLASS} = 'INDUSTRY'),
t AS (SELECT * FROM s WHERE company_name <> '' AND company_name <> 'State University' AND NOT starts_with(company_name, 'Zeta') AND company_name <> 'Gone Pharma'),
u AS (SELECT company_name, 'clinical_trial_phase_transition' AS signal_type, 'https://trials.example/study/N' || k || '#PHASE' || CASE kind WHEN 1 THEN 'Phase2' WHEN 2 THEN 'Phase1/2' ELSE 'Phase3' END AS source_url, CASE kind WHEN 3 THEN 'Phase 2' ELSE 'Phase 1' END AS phase_from,
 CASE kind WHEN 1 THEN 'Phase 2' WHEN 2 THEN 'Phase 1/2' ELSE 'Phase 3' END AS phase_to, summary, 30 + CASE WHEN company_name = 'Rho Labs' THEN 15 ELSE 0 END AS priority_score, k FROM t WHERE kind <> 0
UNION ALL SELECT company_name, 'clinical_trial_new_ind', 'https://trials.example/study/N' || k || '#IND', 'Pre-Clinical', 'Phase 1', summary, 22 + CASE WHEN company_name = 'Rho Labs' THEN 15 ELSE 0 END, k FROM t WHERE kind = 0 AND posted >= DATE '2024-01-16')
SELECT * EXCLUDE (k, priority_score), priority_score::BIGINT AS priority_score FROM u WHERE NOT (signal_type = 'clinical_trial_new_ind' AND k % 8 = 0)""")
def l16(spark, sf):
    """Seen: every other new drug; excluded: Zeta; dismissed in both kinds: Gone Pharma."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    studies = _studies(spark, sf)
    k = F.substring("nct_id", 2, 20).cast("long")
    seen = studies.filter(k % 8 == 0).select(c("sponsor").alias("company_name"), F.lit("clinical_trial_new_ind").alias("signal_type"), F.concat(F.lit("https://trials.example/study/"), "nct_id", F.lit("#IND")).alias("source_url"))
    gone = frame([("Gone Pharma", "clinical_trial_phase_transition"), ("Gone Pharma", "clinical_trial_new_ind"), ("Rho Labs", "clinical_trial_new_ind")], "company_name string, signal_type string")
    out = agents.trial_signals(studies, seen, frame([("Zeta",)], "name string"), gone, frame([("Rho Labs", 1, True)], "name string, rank int, is_active boolean"), "2024-02-15")
    return out.withColumn("priority_score", c("priority_score").cast("long"))


_ORG = "CASE o_orderkey % 5 WHEN 0 THEN 'Acme Bio ' || o_custkey WHEN 1 THEN 'Duke University' WHEN 2 THEN 'Zeta Labs' WHEN 3 THEN '' ELSE 'Rho Therapeutics' END"


@query("L17_grant_signals", f"""WITH g AS (SELECT o_orderkey AS k, {_ORG} AS company_name, o_totalprice AS x FROM orders WHERE o_orderkey % 7 <> 0)
SELECT company_name, CASE WHEN k % 4 = 0 THEN 'funding_new_award' ELSE 'funding_renewal' END AS signal_type, 'https://grants.example/' || k AS source_url, 'Award of $' || floor(x / 1000 + 0.5)::BIGINT || 'K: Title ' || k AS summary, 20 AS priority_score
FROM g WHERE company_name NOT IN ('', 'Duke University', 'Zeta Labs') AND k % 10 <> 5 AND NOT (company_name = 'Rho Therapeutics' AND k % 4 <> 0) AND company_name <> 'Acme Bio 7'""")
def l17b(spark, sf):
    """Dismissed: renewals of Rho, new awards and renewals of one Acme; a rule that is off."""
    g = read(spark, sf, "orders").selectExpr(f"{_ORG} AS org_name", "CASE WHEN o_orderkey % 7 = 0 THEN 'https://x.edu/a' END AS org_url", "CASE o_orderkey % 4 WHEN 0 THEN 'R43' WHEN 1 THEN 'R44' END AS activity_code", "o_totalprice AS award_amount", "'Title ' || o_orderkey AS project_title", "'https://grants.example/' || o_orderkey AS project_url", "o_orderkey AS k")
    seen = g.filter("k % 10 = 5").select(c("org_name").alias("company_name"), F.when(c("k") % 4 == 0, "funding_new_award").otherwise("funding_renewal").alias("signal_type"), c("project_url").alias("source_url"))
    rules = _rules(spark, ("funding_renewal", "company", "RHO therapeutics", True), *[(t, "company", "acme bio 7", True) for t in ("funding_renewal", "funding_new_award")], ("funding_new_award", "company", "Rho Therapeutics", False), ("funding_new_award", "location", "Acme Bio 8", True))
    return agents.grant_signals(g, seen, spark.createDataFrame([("Zeta",)], "name string"), rules)


def _rules(spark, *rows):
    return spark.createDataFrame(list(rows), "signal_type string, rule_type string, rule_value string, auto_exclude boolean")


_FILER = "CASE o_orderkey % 5 WHEN 0 THEN 'Acme Therapeutics ' || o_custkey WHEN 1 THEN 'Plain Stores Inc' WHEN 2 THEN 'Maple Pharma Canada' WHEN 3 THEN 'Duke University Oncology' ELSE 'Zeta Biologics Inc' END"


@query("L17_filing_signals", f"""WITH f AS (SELECT o_orderkey AS k, {_FILER} AS company_name FROM orders)
SELECT company_name, 'A-' || k AS accession_number, CASE k % 3 WHEN 0 THEN 'merger' WHEN 1 THEN 'partnership' ELSE 'acquisition' END AS transaction_type, CASE k % 3 WHEN 0 THEN '$2B' END AS deal_value, CASE k % 3 WHEN 0 THEN 'Omega Corp' ELSE '' END AS other, 27 AS priority_score
FROM f WHERE starts_with(company_name, 'Acme') AND NOT (k % 6 = 5 AND k % 12 <> 5) AND company_name NOT IN ('Acme Therapeutics 10', 'Acme Therapeutics 25')""")
def l17c(spark, sf):
    """Accessions that were seen within 180 days don't come again; two filers are
    dismissed."""
    rules = _rules(spark, *[("ma_transaction", "company", f"acme THERAPEUTICS {i}", True) for i in (10, 25)])
    text = "CASE o_orderkey % 3 WHEN 0 THEN 'The merger agreement with Omega Corp. for $2 billion was signed' WHEN 1 THEN 'a license agreement was made' ELSE '' END"
    f = read(spark, sf, "orders").selectExpr(f"{_FILER} AS company_name", "'A-' || o_orderkey AS accession_number", f"{text} AS text", "o_orderkey AS k")
    seen = f.filter("k % 6 = 5").select("accession_number", F.when(c("k") % 12 == 5, F.lit("2023-01-01")).otherwise("2024-01-01").cast("timestamp").alias("created_at"))
    out = agents.filing_signals(f.select("company_name", "accession_number", "k"), f.select("accession_number", "text"), seen, spark.createDataFrame([("Zeta",)], "name string"), "2024-02-01", rules)
    return out.select("company_name", "accession_number", "transaction_type", "deal_value", c("acquired_name").alias("other"), "priority_score")


# five sources that know some of the firms by their number k: posts, then pages
_FIRM = "'Firm ' || (o_custkey % 300)"
_KINDS = "CASE k % 8 WHEN 1 THEN 'ipo' WHEN 3 THEN 'acquisition' WHEN 5 THEN 'merger' WHEN 7 THEN 'partnership' END"


@query("L17_I68_enriched_deals", f"""WITH s AS (SELECT o_orderkey AS id, {_FIRM} AS company_name, (o_custkey % 300)::BIGINT AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'merger' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN '$1M' WHEN 1 THEN '' END AS v, CASE o_orderkey % 3 WHEN 0 THEN 'Given Co' WHEN 1 THEN '' END AS p FROM orders),
a AS (SELECT id, company_name, k, coalesce(kind, {_KINDS}) AS kind, nullif(v, '') AS v, nullif(p, '') AS p, NULL AS d, CASE WHEN k % 2 = 1 THEN 'https://posts.example/' || k END AS u, CASE WHEN nullif(v, '') IS NOT NULL OR nullif(p, '') IS NOT NULL THEN 'filing' WHEN k % 2 = 1 THEN 'posts' END AS f, 0 AS n FROM s),
b AS (SELECT id, company_name, k, kind, CASE WHEN k % 3 = 0 THEN coalesce(v, CASE WHEN k % 2 = 0 THEN '$7M' ELSE '$3B' END) ELSE v END AS v, CASE WHEN k % 6 = 0 AND n >= 0 AND (v IS NULL OR p IS NULL) THEN coalesce(p, 'Beta Labs') ELSE p END AS p, CASE WHEN k % 6 = 0 THEN 'We have acquired Beta Labs, a firm' END AS d,
 CASE WHEN k % 3 = 0 THEN coalesce(u, CASE WHEN k % 2 = 0 THEN 'https://www.f' || k || '.example/news' ELSE 'https://ir.example/' || k END) ELSE u END AS u, CASE WHEN k % 3 = 0 AND (f IS NULL OR f = 'filing') THEN 'investor_relations' ELSE f END AS f, 1 AS n FROM a WHERE v IS NULL OR p IS NULL UNION ALL SELECT * FROM a WHERE v IS NOT NULL AND p IS NOT NULL),
e AS (SELECT id, company_name, k, kind, CASE WHEN k % 4 = 0 THEN coalesce(v, '$9M') ELSE v END AS v, p, CASE WHEN k % 4 = 0 THEN coalesce(d, 'News of Firm ' || k || ' today') ELSE d END AS d, CASE WHEN k % 4 = 0 THEN coalesce(u, 'https://n.example/' || k) ELSE u END AS u, CASE WHEN k % 4 = 0 AND (f IS NULL OR f = 'filing') THEN 'search' ELSE f END AS f, n + 1 AS n FROM b WHERE v IS NULL OR p IS NULL
 UNION ALL SELECT * FROM b WHERE v IS NOT NULL AND p IS NOT NULL),
g AS (SELECT id, company_name, k, kind, CASE WHEN k % 5 < 2 THEN coalesce(v, CASE k % 5 WHEN 0 THEN '$45M' ELSE '$2B' END) ELSE v END AS v, CASE WHEN k % 5 = 0 THEN coalesce(p, 'Omega Bio') ELSE p END AS p, CASE k % 5 WHEN 0 THEN coalesce(d, 'Firm acquires Omega Bio for $45 million & more') WHEN 1 THEN coalesce(d, 'A licensing pact') ELSE d END AS d,
 CASE k % 5 WHEN 0 THEN coalesce(u, 'https://dive.example/a' || k) WHEN 1 THEN coalesce(u, 'https://o.example/b') ELSE u END AS u, CASE WHEN k % 5 < 2 AND (f IS NULL OR f = 'filing') THEN 'dive' ELSE f END AS f, n + 1 AS n FROM e WHERE v IS NULL OR p IS NULL UNION ALL SELECT * FROM e WHERE v IS NOT NULL AND p IS NOT NULL),
h AS (SELECT id, company_name, k, kind, CASE WHEN k % 7 = 0 THEN coalesce(v, '$88M') ELSE v END AS v, CASE WHEN k % 7 = 0 THEN coalesce(p, 'Delta Works') ELSE p END AS p, CASE WHEN k % 7 = 0 THEN coalesce(d, 'Firm partners with Delta Works for $88 million') ELSE d END AS d, CASE WHEN k % 7 = 0 THEN coalesce(u, 'https://trade.example/t' || k) ELSE u END AS u,
 CASE WHEN k % 7 = 0 AND (f IS NULL OR f = 'filing') THEN 'trade' ELSE f END AS f, n + 1 AS n FROM g WHERE v IS NULL OR p IS NULL UNION ALL SELECT * FROM g WHERE v IS NOT NULL AND p IS NOT NULL)
SELECT id, company_name, kind AS transaction_type, v AS deal_value, p AS counterparty, d AS deal_summary, u AS enrichment_url, f AS enrichment_source, n AS n_asked FROM h""")
def l17d(spark, sf):
    """Five sources over the customers' numbers; rows stop at each of them."""
    signals = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_FIRM} AS company_name", "CASE WHEN o_orderkey % 2 = 0 THEN 'merger' END AS transaction_type", "CASE o_orderkey % 4 WHEN 0 THEN '$1M' WHEN 1 THEN '' END AS deal_value", "CASE o_orderkey % 3 WHEN 0 THEN 'Given Co' WHEN 1 THEN '' END AS counterparty")
    firms = read(spark, sf, "orders").select((c("o_custkey") % 300).alias("k")).distinct().withColumn("company_name", F.expr("'FIRM ' || k"))
    some = lambda test, html: firms.filter(test).withColumn("html", F.expr(html))
    posts = firms.filter("k % 2 = 1").selectExpr("company_name", f"{_KINDS} AS transaction_type", "'https://posts.example/' || k AS source_url")
    investors = some("k % 3 = 0", "CASE WHEN k % 2 = 0 THEN '<a href=\"/x\">Our careers page is here</a><a href=\"news\">We have acquired Beta Labs, a firm</a> for $7 million' ELSE 'A transaction of $3 billion <a href=\"/y\">Something else at all</a>' END || repeat('<p>filler</p>', 60)")
    search = some("k % 4 = 0", "'<a aria-label=\"Some other article\" href=\"/1\">x</a><a aria-label=\"News of Firm ' || k || ' today\" href=\"/' || k || '\">x</a>'").withColumn("page", F.lit("<p>It paid</p> <b>$9</b>M <b>$9 million</b>"))
    dive = some("k % 5 < 2", "CASE k % 5 WHEN 0 THEN '<article><h3>Firm acquires Omega Bio for $45 million &amp; more</h3><a href=\"/a' || k || '\">x</a>January 5, 2024</article>' ELSE '<article><span class=\"c title\">A licensing pact</span><a href=\"https://o.example/b\">x</a><p class=\"summary\">It is worth two or $2 billion at most</p></article>' END")
    trade = some("k % 7 = 0", "'<article><h2>Firm partners with Delta Works for $88 million</h2><a href=\"/t' || k || '\">x</a></article>'")
    since = F.lit("2024-01-01").cast("date")
    pages = [
        Source("search", search, readers.search_deal(readers.search_choice(c("html"), c("company_name"), "https://n.example", "n.example"), c("page"))),
        Source("dive", dive, readers.trade_deal(c("html"), "dive", "https://dive.example", since)), Source("trade", trade, readers.trade_deal(c("html"), "teaser", "https://trade.example", since)),
    ]
    # an investors' page has its firm's domain: the address is put in behind the reading
    domain = readers.investor_deal(c("html"), "FIRM.example", F.concat(F.lit("https://ir.example/"), c("k").cast("string")))
    at = F.replace(domain["source_url"], F.lit("FIRM.example"), F.concat(F.lit("f"), c("k").cast("string"), F.lit(".example")))
    own = Source("investor_relations", investors, F.when(domain.isNotNull(), F.struct(domain["deal_value"].alias("deal_value"), domain["counterparty"].alias("counterparty"), domain["deal_summary"].alias("deal_summary"), at.alias("source_url"))))
    return enrich_deals(signals, posts, [own, *pages])


_TRIAL_SPONSOR = "CASE WHEN o_custkey % 8 = 0 THEN 'ACME ' || o_custkey || ' INC' ELSE 'Nobody ' || o_custkey END"


@query("L20_trial_scan", cte("directory") + """, d AS (SELECT name, size FROM directory WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY coalesce(try_cast(regexp_extract(replace(size, ',', ''), '(\\d+)', 1) AS BIGINT), 0) DESC, size NULLS FIRST) = 1),
m AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 24 = 0 THEN 'Zeta 7' WHEN o_custkey % 8 = 0 THEN 'Acme ' || o_custkey || ', Inc.' END AS matched_name FROM orders)
SELECT 'N' || k AS nct_id, matched_name, size AS company_size, CASE WHEN k % 3 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM m LEFT JOIN d ON d.name = matched_name""")
def l20b(spark, sf):
    """Some sponsors are known already: under another name, or as no match."""
    t = read(spark, sf, "orders").selectExpr("'N' || o_orderkey AS nct_id", f"{_TRIAL_SPONSOR} AS sponsor", "CAST(NULL AS ARRAY<STRING>) AS emails", "o_custkey", "o_orderkey AS k")
    known = t.filter("o_custkey % 24 = 0 OR o_custkey % 8 = 1").selectExpr("lower(sponsor) AS alternate_name", "CASE WHEN o_custkey % 24 = 0 THEN 'Zeta 7' ELSE sponsor END AS directory_name", "CASE WHEN o_custkey % 24 = 0 THEN 'exact_name' ELSE 'no_match' END AS matched_via")
    out, _ = scans.trial_scan(t.select("nct_id", "sponsor", "emails"), t.filter("k % 3 = 0").select("nct_id"), known, view(spark, sf, "directory"))
    return out.select("nct_id", "matched_name", "company_size", "action")


@query("L20_scan_learns_names", "SELECT DISTINCT CASE WHEN o_custkey % 8 = 0 THEN 'Acme ' || o_custkey || ', Inc.' ELSE 'Nobody ' || o_custkey END AS directory_name, CASE WHEN o_custkey % 8 = 0 THEN 'ACME ' || o_custkey || ' INC' ELSE 'Nobody ' || o_custkey END AS alternate_name, CASE WHEN o_custkey % 8 = 0 THEN 'exact_name' ELSE 'no_match' END AS matched_via FROM orders WHERE o_custkey % 8 <> 1")
def l20c(spark, sf):
    t = read(spark, sf, "orders").selectExpr("'N' || o_orderkey AS nct_id", f"{_TRIAL_SPONSOR} AS sponsor", "CAST(NULL AS ARRAY<STRING>) AS emails", "o_custkey")
    known = t.filter("o_custkey % 8 = 1").selectExpr("upper(sponsor) AS alternate_name", "sponsor AS directory_name", "'no_match' AS matched_via")
    return scans.trial_scan(t.select("nct_id", "sponsor", "emails"), t.limit(0).select("nct_id"), known, view(spark, sf, "directory"))[1]


_GRANT_ORG = "CASE o_orderkey % 3 WHEN 0 THEN 'ACME ' || (o_custkey - o_custkey % 8) || ' INC' WHEN 1 THEN 'Nobody ' || o_custkey ELSE 'Therapeutics 17 Beta' END"


@query("L20_grant_scan", """SELECT 'G' || o_orderkey AS appl_id, CASE o_orderkey % 3 WHEN 0 THEN 'Acme ' || (o_custkey - o_custkey % 8) || ', Inc.' WHEN 2 THEN 'Beta Therapeutics 17 Corp.' END AS matched_name, CASE o_orderkey % 3 WHEN 0 THEN 'exact_name' WHEN 2 THEN 'keyword' END AS matched_via FROM orders WHERE o_orderkey % 5 <> 0""")
def l20d(spark, sf):
    g = read(spark, sf, "orders").selectExpr("'G' || o_orderkey AS appl_id", f"{_GRANT_ORG} AS org_name", "o_orderkey AS k")
    twice = g.unionByName(g.withColumn("org_name", F.concat("org_name", F.lit("~"))))
    return scans.grant_scan(twice.select("appl_id", "org_name"), g.filter("k % 5 = 0").select("appl_id"), view(spark, sf, "directory")).select("appl_id", "matched_name", "matched_via")


_TITLE = "CASE event_id % 4 WHEN 0 THEN 'Zeta ' || (event_id % 50) || ' raises money' WHEN 1 THEN 'News of Nobody' WHEN 2 THEN 'Up: omega does well' ELSE 'Zeta ' || (event_id % 50) || 'x falls' END"


@query("L20_news_scan", cte("directory") + f"""SELECT 'u' || event_id AS article_url, CASE event_id % 4 WHEN 0 THEN CASE WHEN 'Zeta ' || (event_id % 50) IN (SELECT name FROM directory) THEN 'Zeta ' || (event_id % 50) END WHEN 2 THEN 'Omega Ltd' END AS names
FROM events WHERE event_id % 6 <> 0 AND (event_id % 5 = 0 OR CAST(ts AS DATE) >= DATE '2024-01-03')""")
def l20e(spark, sf):
    e = read(spark, sf, "events").selectExpr(f"{_TITLE} AS title", "'u' || event_id AS article_url", "CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS article_date", "event_id")
    alternates = spark.createDataFrame([("omega", "Omega Ltd")], "alternate_name string, directory_name string")
    cards = e.drop("event_id").unionByName(e.withColumn("title", F.concat("title", F.lit(" again"))).drop("event_id"))
    out = scans.news_scan(cards, e.filter("event_id % 6 = 0").select("article_url"), view(spark, sf, "directory"), alternates, F.lit("2024-01-03").cast("date"))
    return out.select("article_url", F.array_join("matched_names", "|").alias("names"))


@query("L20_scan_counts", "SELECT count(*) * 2 AS fetched, count(*) FILTER (o_orderkey % 5 <> 0) AS new, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 1) AS matched, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 3 = 1) AS unmatched FROM orders")
def l20f(spark, sf):
    """Counted by the write of the scan itself."""
    g = read(spark, sf, "orders").selectExpr("'G' || o_orderkey AS appl_id", f"{_GRANT_ORG} AS org_name", "o_orderkey AS k")
    twice = g.unionByName(g.withColumn("org_name", F.concat("org_name", F.lit("~")))).select("appl_id", "org_name")
    fetched, seen = scans.counted_fetch(twice)
    n = scans.write_scan(scans.grant_scan(fetched, g.filter("k % 5 = 0").select("appl_id"), view(spark, sf, "directory")), staging.place(spark, "scan"))
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in {**seen.get, **n}.items()])


@query("L19_orchestrator", """WITH s AS (SELECT event_id % 3 AS kind, CAST(ts AS TIMESTAMP) AS since, CASE WHEN event_id % 5 = 0 THEN 'dismissed' ELSE 'new' END AS status FROM events)
SELECT 'trials' AS agent, count(*) AS n FROM s WHERE kind = 1 UNION ALL SELECT 'funding', count(*) FROM s WHERE kind = 2
UNION ALL SELECT 'carried_forward', count(*) FILTER (status = 'new' AND since < TIMESTAMP '2024-01-10') FROM s UNION ALL SELECT 'active', count(*) FILTER (status = 'new') FROM s""")
def l19(spark, sf):
    zero = ", ".join(f"CAST(0 AS BIGINT) AS {x}" for x in ("strength", "base", "warmth", "actionability", "boost", "nested_boost"))
    s = read(spark, sf, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS first_detected_at", "CASE WHEN event_id % 5 = 0 THEN 'dismissed' ELSE 'new' END AS status", *zero.split(", "))
    part = lambda i: s.filter(f"event_id % 3 = {i}")
    return scans.orchestrate(part(0), {"trials": part(1), "funding": part(2)}, "2024-01-10")[1]


_CARD = "'<li><h3 class=\"base-search-card__title\">' || CASE WHEN p_partkey % 6 = 5 THEN '' ELSE 'Job ' || p_partkey END || '</h3><h4 class=\"base-search-card__subtitle\">Firm &amp; ' || p_partkey || '</h4><span class=\"job-search-card__location\">Boston</span><a href=\"/jobs/view/x-' || p_partkey || '?r=1\">x</a><time>' || (p_partkey % 4 + 1) || ' weeks ago</time></li>'"


@query("A15_job_cards", """SELECT 'Job ' || p_partkey AS title, 'Firm & ' || p_partkey AS company, 'Boston' AS location, 'https://j.example/jobs/view/x-' || p_partkey AS job_url, (p_partkey % 4 + 1) * 7 AS days_posted
FROM part WHERE p_partkey % 6 <> 5 QUALIFY row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) <= 25""")
def a15(spark, sf):
    """Four pages of very many cards: the first 25 with a title of each."""
    cards = read(spark, sf, "part").selectExpr("p_partkey % 4 AS page", f"struct(p_partkey, {_CARD} AS card) AS x")
    pages = cards.groupBy("page").agg(F.concat(F.lit("<ul>"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["card"]), ""), F.lit("</ul>")).alias("html"))
    return readers.job_cards(pages, "html", "2024-01-01", "https://j.example")


@query("A15_job_pages", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A long description of a job that needs many words, number ' || doc_id WHEN 1 THEN 'The second place holds the description of this job, number ' || doc_id ELSE 'Only the page itself says what it is about ' || doc_id END AS description,
CASE doc_id % 4 WHEN 0 THEN 'Kim & Co' WHEN 1 THEN 'Lee' WHEN 2 THEN 'Ann O''Hara' ELSE 'Unknown' END AS hires FROM documents""")
def a15b(spark, sf):
    body = "CASE doc_id % 3 WHEN 0 THEN '<div class=\"description__text rich\">A <b>long</b> description of a job that needs many words, number ' || doc_id || '</div>' WHEN 1 THEN '<div class=\"description__text\">short</div><section class=\"show-more-less-html__markup\">The second place holds the description of this job, number ' || doc_id || '</section>' ELSE '<nav>menu</nav><p>Only the page itself says what it is about ' || doc_id || '</p><script>x</script>' END"
    team = "CASE doc_id % 4 WHEN 0 THEN '<footer class=\"hiring-team\"><h3 class=\"base-main-card__title\"> Kim &amp; Co </h3></footer>' WHEN 1 THEN '<footer data-poster-name=\"Lee\"></footer>' WHEN 2 THEN '<footer>Posted by <b>Ann O\\'Hara</b></footer>' ELSE '' END"
    page = F.expr(f"{body} || {team}")
    return read(spark, sf, "documents").select("doc_id", readers.job_description(page).alias("description"), readers.hiring_name(page).alias("hires"))


@query("I19_article_links", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'First & title of ' || page_id || '|https://n.example/a' || page_id || ';Second title here|https://o.example/b' WHEN 1 THEN 'Address first ' || page_id || '|https://n.example/c' ELSE 'A plain link with a long text|https://www.site.example/x' || page_id END AS links FROM pages""")
def i19(spark, sf):
    html = F.expr("CASE page_id % 3 WHEN 0 THEN '<a class=\"x\" aria-label=\"First &amp; title of ' || page_id || '\" href=\"/a' || page_id || '\">z</a><a q aria-label=\"Second title here\" href=\"https://o.example/b\">y</a><a q aria-label=\"The same url again\" href=\"https://o.example/b\">y</a>' WHEN 1 THEN '<a href=\"/c\" aria-label=\"Address first ' || page_id || '\">t</a><a href=\"https://www.site.example/n\">A plain link that is not looked at</a>' ELSE '<a href=\"https://www.site.example/x' || page_id || '\">A plain link with a long text</a><a href=\"https://www.site.example/s\">short</a>' END")
    links = readers.article_links(html, "https://n.example", "www.site.example")
    return read(spark, sf, "pages").select("page_id", F.array_join(F.transform(links, lambda x: F.concat(x["title"], F.lit("|"), x["url"])), ";").alias("links"))


_SUM = "CASE o_orderkey % 6 WHEN 0 THEN 'paid $45 million, then $1,200.5 Billion' WHEN 1 THEN 'worth $ 1,045.5 MILLION' WHEN 2 THEN 'of 3 billion dollars' WHEN 3 THEN 'about 7 million USD' WHEN 4 THEN 'a sum of $45M' ELSE '' END"


@query("I55b_amount_words", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '$1200.5 billion' WHEN 1 THEN '$1045.5 million' WHEN 2 THEN '$3 billion' WHEN 3 THEN '$7 million' END AS amount FROM orders")
def i55b(spark, sf):
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), T.amount_words(F.expr(_SUM)).alias("amount"))


_DEAL = "CASE o_orderkey % 6 WHEN 0 THEN 'a definitive agreement to acquire Omega Corp. for $5 million in cash' WHEN 1 THEN 'exclusive rights to AB-123 were had' WHEN 2 THEN 'Big Co (the \"Parent\") signed a merger agreement' WHEN 3 THEN 'the Seller sold AB-123' WHEN 4 THEN 'an underwriting agreement' ELSE 'nothing at all' END"


@query("I22b_backfill_kinds", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 2 THEN 'merger' WHEN 3 THEN 'product_acquisition' WHEN 4 THEN 'ipo' ELSE 'acquisition' END AS kind FROM orders")
def i22b(spark, sf):
    from tidewater.functions import rules as R

    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), T.transaction_kind(F.expr(_DEAL), R.TRANSACTIONS_BACKFILL).alias("kind"))


@query("L15_I24b_reenrichment", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'acquired_name=Omega Corp,acquirer_name=Filer,deal_value=$5 million,k=v,transaction_type=acquisition' WHEN 2 THEN 'acquired_name=Filer,acquirer_name=Big Co,k=v,transaction_type=merger'
WHEN 3 THEN 'acquirer_name=Filer,k=v,transaction_type=product_acquisition' WHEN 4 THEN 'acquirer_name=Filer,k=v,transaction_type=ipo' ELSE 'acquirer_name=Filer,k=v,transaction_type=acquisition' END AS detail FROM orders WHERE o_orderkey % 7 <> 0""")
def l15b(spark, sf):
    """Signals whose detail has a value stay out."""
    s = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.lit("Filer").alias("company_name"), F.concat(F.lit("u"), "o_orderkey").alias("source_url"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN map('deal_value', '$1M') ELSE map('k', 'v', 'acquirer_name', '') END").alias("detail"))
    pages = read(spark, sf, "orders").select(F.concat(F.lit("u"), "o_orderkey").alias("source_url"), F.expr(_DEAL).alias("text"))
    out = scans.enrich(s, pages)
    return out.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("detail")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("detail"))


@query("A4_study_lookup", "SELECT l_orderkey AS id, count(*) AS n, any_value(o_orderstatus) AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def a4(spark, sf):
    """Point lookups of stored signals' studies, as one join."""
    wanted = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(c("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(read(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status")), "id")


@query("A5_A6_recent_grants", "SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-08-01' - 180 AND DATE '1998-08-01' AND o_orderkey % 4 IN (0, 1) AND year(o_orderdate) IN (1997, 1998) AND o_orderkey % 3 <> 0")
def a5(spark, sf):
    g = read(spark, sf, "orders").selectExpr("o_orderkey AS appl_id", "CAST(o_orderdate AS DATE) AS award_notice_date", "CAST(o_orderdate AS DATE) AS date_added", "CASE o_orderkey % 4 WHEN 0 THEN 'R43' WHEN 1 THEN 'R44' ELSE 'R01' END AS activity_code", "year(o_orderdate) AS fiscal_year", "CASE WHEN o_orderkey % 3 = 0 THEN 'SCHOOLS' ELSE 'SMALL BUSINESS' END AS org_type")
    return readers.recent_grants(g, "1998-08-01", 180, ("R43", "R44"), years=(1997, 1998), org_type="SMALL BUSINESS").select(c("appl_id").alias("id"))


_TEXT = "'a&amp;b &#39;q&#39; &#039;r&#039; x&hellip; s&shy;t u&#173;v &#8217;w&#8217; &#x41;&#66; n' || page_id"


@query("I16_entities", """SELECT page_id, 'a&b ''q'' ''r'' x&hellip; s&shy;t u' || chr(173) || 'v ''w'' AB n' || page_id AS filing, 'a&b ''q'' ''r'' x… s&shy;t u' || chr(173) || 'v ’w’ AB n' || page_id AS promo,
'a&b ''q'' ''r'' x… s&shy;t u' || chr(173) || 'v ’w’ AB n' || page_id AS heading, 'a&b ''q'' ''r'' x… st uv ’w’ AB n' || page_id AS relative FROM pages""")
def i16(spark, sf):
    return read(spark, sf, "pages").select("page_id", *[T.decode_entities(F.expr(_TEXT), k).alias(k) for k in ("filing", "promo", "heading", "relative")])


@query("A14_trade_deals", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '$45M' WHEN 1 THEN '$2B' END AS deal_value, CASE page_id % 3 WHEN 0 THEN 'Omega Bio' WHEN 1 THEN '' END AS counterparty, CASE page_id % 3 WHEN 0 THEN 'Acme acquires Omega Bio for $45 million & more' WHEN 1 THEN 'A licensing pact' END AS deal_summary,
CASE page_id % 3 WHEN 0 THEN 'https://t.example/a' || page_id WHEN 1 THEN 'https://o.example/b' END AS source_url FROM pages""")
def a14b(spark, sf):
    """The first card that fits: others tell of no deal or are too old."""
    no, old = '<article><h2>Weekly digest</h2><a href="/w">x</a></article>', '<article><h3>Old merger</h3><a href="/o">x</a>2023-01-01</article>'
    one = "'<article><h3>Acme acquires Omega Bio for $45 million &amp; more</h3><a href=\"/a' || page_id || '\">x</a>January 5, 2024</article>'"
    two = "'<article><span class=\"c title\">A licensing pact</span><a href=\"https://o.example/b\">x</a><p class=\"summary\">It is worth two or $2 billion at most</p></article>'"
    html = F.expr(f"'{no}{old}' || CASE page_id % 3 WHEN 0 THEN {one} WHEN 1 THEN {two} ELSE '' END")
    return read(spark, sf, "pages").select("page_id", readers.trade_deal(html, "dive", "https://t.example", F.lit("2024-01-01").cast("date")).alias("d")).select("page_id", "d.*")


@query("A14_investor_deals", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '$7M' WHEN 1 THEN '$3B' END AS deal_value, CASE page_id % 3 WHEN 0 THEN 'Beta Labs' WHEN 1 THEN '' END AS counterparty, CASE page_id % 3 WHEN 0 THEN 'We have acquired Beta Labs, a firm' WHEN 1 THEN '' END AS deal_summary,
CASE page_id % 3 WHEN 0 THEN 'https://www.a.example/news' WHEN 1 THEN 'https://ir.a.example/' END AS source_url FROM pages""")
def a14c(spark, sf):
    html = F.concat(F.expr("CASE page_id % 3 WHEN 0 THEN '<a href=\"/x\">Our careers page is here</a><a href=\"news\">We have acquired Beta Labs, a firm</a> for $7 million' WHEN 1 THEN 'A transaction of $3 billion <a href=\"/y\">Something else at all</a>' ELSE 'nothing $1 million ' END"), F.repeat(F.lit("<p>filler</p>"), 60))
    return read(spark, sf, "pages").select("page_id", readers.investor_deal(html, "a.example", F.lit("https://ir.a.example/")).alias("d")).select("page_id", "d.*")


@query("A14_search_deals", """SELECT page_id, '$9M' AS deal_value, '' AS counterparty, CASE WHEN page_id % 2 = 0 THEN 'Big Acme News of the day' ELSE 'Some other article' END AS deal_summary, CASE WHEN page_id % 2 = 0 THEN 'https://n.example/2' ELSE 'https://n.example/1' END AS source_url FROM pages""")
def a14d(spark, sf):
    html = F.lit('<a aria-label="Some other article" href="/1">x</a><a aria-label="Big Acme News of the day" href="/2">x</a>')
    company = F.expr("CASE WHEN page_id % 2 = 0 THEN 'ACME NEWS CORP' ELSE 'Nobody' END")
    choice = readers.search_choice(html, company, "https://n.example", "n.example")
    return read(spark, sf, "pages").select("page_id", readers.search_deal(choice, F.lit("<p>It paid</p> <b>$9</b>M <b>$9 million</b>")).alias("d")).select("page_id", "d.*")
