"""Further queries: rules, page parsers, moves and re-matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.operators import resolve, staging, state
from tidewater.operators import tables as O
from tidewater.operators.lookup import once
from tidewater.plans.q_text import q, sql_clean, sql_has
from tidewater.plans.registry import query
from tidewater.plans.views import cte, read, view
from tidewater.sources import rollup, sinks

c = F.col


@query("C18_C20_array_rules", "SELECT p_partkey AS id, p_partkey % 3 <> 0 AS late, p_partkey % 4 <> 1 AS in_us, p_partkey % 5 = 0 AS item FROM part")
def c18(spark, sf):
    p = read(spark, sf, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN array('PHASE1', 'PHASE4') WHEN 1 THEN array('Phase3') ELSE array('PHASE1', 'phase2') END AS phases",
        "CASE p_partkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('France') WHEN 2 THEN array('France', 'United States') END AS places", "CASE WHEN p_partkey % 5 = 0 THEN array('1.01', '9.01') WHEN p_partkey % 5 = 1 THEN array() END AS items",
    )
    late = F.exists("phases", lambda x: F.upper(x).isin("PHASE2", "PHASE3"))
    us = F.coalesce(F.size("places"), F.lit(0)).isin(0, -1) | F.coalesce(F.exists(c("places").cast("array<string>"), lambda x: x == "United States"), F.lit(False))
    return p.select("id", late.alias("late"), us.alias("in_us"), F.coalesce(F.array_contains(c("items").cast("array<string>"), "1.01"), F.lit(False)).alias("item"))


@query("C22_C23_blocked_titles", "WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Human Resources Lead' WHEN 1 THEN 'Talent Acquisition (Human Resources)' WHEN 2 THEN 'Talent Acquisition Writer' WHEN 3 THEN 'Chef' ELSE 'Quality Lead' END AS title FROM part) SELECT id, CASE title WHEN 'Talent Acquisition Writer' THEN 'Medical Writing,Talent Acquisition' WHEN 'Talent Acquisition (Human Resources)' THEN 'Talent Acquisition' ELSE 'Quality Assurance' END AS specialty FROM t WHERE title NOT IN ('Human Resources Lead', 'Chef')")
def c22(spark, sf):
    t = read(spark, sf, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN 'Human Resources Lead' WHEN 1 THEN 'Talent Acquisition (Human Resources)' WHEN 2 THEN 'Talent Acquisition Writer' WHEN 3 THEN 'Chef' ELSE 'Quality Lead' END AS title")
    blocked = spark.range(1).select(F.lit("chef").alias("k"))
    t = once(t.withColumn("k", T.strip(T.clean_title(c("title")))).join(blocked, "k", "left_anti"), s=T.lead_specialty(c("title"), T.specialties(c("title"))))
    return t.filter("s IS NOT NULL").select("id", F.array_join("s", ",").alias("specialty"))


@query("C25_C28_url_rules", "SELECT page_id, contains(lower(url), '.org') AS is_org, regexp_matches('https://www.linkedin.com/company/' || page_id || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/jobs' ELSE '' END, '(?i)^https://www\\.linkedin\\.com/company/[^/?#]+/?$') AS is_company FROM pages")
def c25(spark, sf):
    u = F.expr("'https://www.linkedin.com/company/' || page_id || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/jobs' ELSE '' END")
    return read(spark, sf, "pages").select("page_id", F.contains(F.lower("url"), F.lit(".org")).alias("is_org"), F.when(u.isNotNull(), T.company_url(u)).alias("is_company"))


_DETAIL = """'{"enrichment_source":"' || CASE WHEN event_id % 2 = 0 THEN 'sec_8k_filing' ELSE 'other' END || '","transaction_type":"' || CASE WHEN event_id % 3 = 0 THEN 'ipo' ELSE 'merger' END || '","acquired_name":"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'X' END || '"}'"""


@query("C27_needs_enrichment", "SELECT event_id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 5 <> 0) AND NOT (event_id % 3 = 0 AND event_id % 2 = 0)")
def c27(spark, sf):
    d = read(spark, sf, "events").selectExpr("event_id", f"{_DETAIL} AS d")
    j = lambda k: F.coalesce(F.get_json_object("d", f"$.{k}"), F.lit(""))
    done = j("enrichment_source") == "sec_8k_filing"
    return d.filter(~(done & (j("acquired_name") != "")) & ~(done & (j("transaction_type") == "ipo"))).select("event_id")


@query("D5b_D5c_rematch", cte("directory") + f", j AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Zeta ' || (s_suppkey % 50) || ' Inc' ELSE 'Other' END AS company_name, CASE WHEN s_suppkey % 3 = 0 THEN 'kept' END AS matched_name FROM supplier), d AS (SELECT {sql_clean('name')} AS e, min(name) AS name FROM directory GROUP BY 1) SELECT id, coalesce(matched_name, d.name) AS matched_name FROM j LEFT JOIN d ON d.e = {sql_clean('company_name')} AND matched_name IS NULL")
def d5b(spark, sf):
    j = read(spark, sf, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN 'Zeta ' || (s_suppkey % 50) || ' Inc' ELSE 'Other' END AS company_name", "CASE WHEN s_suppkey % 3 = 0 THEN 'kept' END AS matched_name")
    d = view(spark, sf, "directory").groupBy(T.clean_name(c("name")).alias("e")).agg(F.min("name").alias("found"))
    out = j.withColumn("e", F.when(c("matched_name").isNull(), T.clean_name(c("company_name")))).join(d, "e", "left")
    return out.select("id", F.coalesce("matched_name", "found").alias("matched_name"))


@query("D21_cascade_delete", "SELECT 'lead' AS t, n_nationkey AS k FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'crm', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def d21(spark, sf):
    n = read(spark, sf, "nation")
    gone = n.filter("n_regionkey = 1").select("n_nationkey")
    crm = read(spark, sf, "customer").join(gone.select(c("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti")
    return O.delete_by_key(n, gone, ["n_nationkey"]).select(F.lit("lead").alias("t"), c("n_nationkey").cast("long").alias("k")).union(crm.select(F.lit("crm"), "c_custkey"))


@query("E5_one_row_counts", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS owing")
def e5(spark, sf):
    n = lambda t, x, a: read(spark, sf, t).agg(F.count_if(F.expr(x)).alias(a))
    return n("orders", "o_orderstatus = 'O'", "open").join(n("lineitem", "l_returnflag = 'R'", "returned")).join(n("customer", "c_acctbal < 0", "owing"))


@query("E15_run_counters", "SELECT CASE WHEN c_custkey % 5 = 4 THEN 'no_match' WHEN c_custkey % 2 = 0 THEN 'exact_name' ELSE 'keyword' END AS matched_via, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1")
def e15(spark, sf):
    """Counted by the write: every seventh row is stored already, and all are twice."""
    via = F.when(c("c_custkey") % 5 == 4, "no_match").when(c("c_custkey") % 2 == 0, "exact_name").otherwise("keyword")
    rows = read(spark, sf, "customer").select("c_custkey", via.alias("matched_via"))
    path = staging.place(spark, "runs")
    sinks.append_new(rows.filter("c_custkey % 7 = 0"), path, ["c_custkey"], ["matched_via"])
    kinds = ("no_match", "exact_name", "keyword")
    n = sinks.append_new(rows.union(rows), path, ["c_custkey"], ["matched_via"], **{k: F.count_if(c("matched_via") == k) for k in kinds})
    return spark.range(1).select(F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.lit(n[k]))])).alias("matched_via", "n"))


@query("A28_incremental_rollup", "SELECT user_id % 1000 AS company_id, event_type, count(*) AS n FROM events WHERE event_id % 17 <> 0 AND NOT (event_id % 4 = 3 AND event_id % 5 = 0) GROUP BY ALL")
def a28(spark, sf):
    """Signals in four batches, of which the third comes again and the first two become
    the base; the fifth deletes some rows, the sixth takes others back that had come in
    the fourth."""
    e = read(spark, sf, "events").selectExpr("event_id", "user_id % 1000 AS company_id", "event_type")
    path, keys = staging.place(spark, "rollup"), ["company_id", "event_type"]
    for batch in (0, 1, 2, 2, 3):
        rollup.add_batch(path, batch, keys, e.filter(c("event_id") % 4 == batch))
        if batch == 1:
            rollup.compact(spark, path, keys, 1)
    rollup.add_batch(path, 1, keys, e)
    back = e.filter("event_id % 4 = 3 AND event_id % 5 = 0")
    rollup.add_batch(path, 4, keys, e.limit(0), e.filter("event_id % 17 = 0"))
    rollup.add_batch(path, 5, keys, back.filter("event_id % 17 = 0"), back)
    return rollup.current(spark, path, keys)


@query("G3_G4_top_totals", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 50")
def g3(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "o_custkey").limit(50)


@query("G5_longest_first", "SELECT first_word, string_agg(p_name, '|' ORDER BY length(p_name) DESC, p_name) AS names FROM (SELECT DISTINCT regexp_extract(lower(p_name), '[a-z0-9]+') AS first_word, p_name FROM part) GROUP BY 1")
def g5(spark, sf):
    p = read(spark, sf, "part").select(T.first_word(c("p_name")).alias("first_word"), "p_name").distinct()
    order = F.transform(F.array_sort(F.collect_list(F.struct(-F.length("p_name"), "p_name"))), lambda x: x["p_name"])
    return p.groupBy("first_word").agg(F.array_join(order, "|").alias("names"))


@query("G7_first_n", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def g7(spark, sf):
    return read(spark, sf, "lineitem").orderBy(c("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber")


@query("H2_news_union", "SELECT 'a' AS src, doc_id AS id FROM documents WHERE source = 'src1' UNION ALL SELECT 'b', doc_id FROM documents WHERE source = 'src2' UNION ALL SELECT 'c', page_id FROM pages")
def h2(spark, sf):
    d = read(spark, sf, "documents")
    return O.union_tagged({"a": d.filter("source = 'src1'").select(c("doc_id").alias("id")), "b": d.filter("source = 'src2'").select(c("doc_id").alias("id")), "c": read(spark, sf, "pages").select(c("page_id").alias("id"))}, "src").select("src", "id")


@query("H5_ids_of_rules", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09")
def h5(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_orderkey").union(read(spark, sf, "lineitem").filter("l_discount > 0.09").select("l_orderkey")).distinct()


@query("I9_display_case", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Merck & CO., Inc.' WHEN 1 THEN 'Big AG Labs' ELSE 'Llc Of CRO X' END AS shown FROM supplier")
def i9(spark, sf):
    return read(spark, sf, "supplier").select(c("s_suppkey").alias("id"), T.display_case(F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'MERCK & CO., Inc., Rahway, NJ, USA' WHEN 1 THEN 'big AG labs,' ELSE 'LLC of CRO x' END")).alias("shown"))


@query("I27_I28_filer_fields", "SELECT o_orderkey AS id, 'Acme ' || o_custkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'ACM' END AS ticker, 'https://filings.example/data/' || ltrim(CAST(o_custkey AS VARCHAR), '0') || '/000112/0001-12.txt' AS url FROM orders")
def i27(spark, sf):
    n = T.display_name(F.expr("'Acme ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' (ACM)' ELSE '' END || ' (CIK 7)'"))
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), n["name"].alias("name"), n["ticker"].alias("ticker"), T.filing_url(F.concat(F.lit("000"), c("o_custkey")), F.lit("0001-12")).alias("url"))


@query("I32_I37_job_fields", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '1' || (10000000 + p_partkey) ELSE '77' END AS job_id, CASE WHEN p_partkey % 3 = 0 THEN 'Lead at Lab' ELSE 'Chef' END AS role, CASE WHEN p_partkey % 3 = 0 THEN 'Beta' END AS company, 'We at hire ' || p_partkey AS scrubbed FROM part")
def i32(spark, sf):
    u = F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'https://j/x-1' || (10000000 + p_partkey) || '?a' ELSE 'https://j/jobs/view/lead-at-x-77?b' END")
    h = T.headline_role(F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'Lead at Lab' ELSE 'Chef' END || CASE WHEN p_partkey % 3 = 0 THEN ' At Beta' ELSE '' END"))
    text = F.expr("'We at ACME  hire ' || p_partkey")
    role = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'Lead at Lab' ELSE 'Chef' END")
    return read(spark, sf, "part").select(c("p_partkey").alias("id"), T.job_id(u).alias("job_id"), role.alias("role"), h["company"].alias("company"), T.without_name(text, F.lit("acme")).alias("scrubbed"))


@query("I36_A16_profile_pages", "SELECT page_id, 'Acme ' || page_id AS page_name, 'Beta ' || page_id AS company, (page_id * 10)::INT AS members FROM pages")
def i36(spark, sf):
    html = F.expr("'<title>(3) Acme ' || page_id || ': About | X</title><p>2019 · now</p><p>Beta ' || page_id || ' · Full-time</p>jobSearchUrl x employeeCountRange y start&quot;:' || (page_id * 10)")
    return read(spark, sf, "pages").select("page_id", T.page_company(html).alias("page_name"), T.profile_company(html).alias("company"), T.employee_count(html).alias("members"))


@query("I63_I38_summaries", cte("directory") + "SELECT id, coalesce(nullif(domain, ''), nullif(size, ''), 'an undisclosed indication') || ' evaluating ' || coalesce(industry, 'an investigational agent') AS summary FROM directory")
def i63(spark, sf):
    none = lambda x: F.nullif(c(x), F.lit(""))
    return view(spark, sf, "directory").select("id", F.concat(F.coalesce(none("domain"), none("size"), F.lit("an undisclosed indication")), F.lit(" evaluating "), F.coalesce("industry", F.lit("an investigational agent"))).alias("summary"))


@query("I66_history", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_nationkey % 3 = 1 THEN 2 ELSE 1 END AS n FROM nation")
def i66(spark, sf):
    h = F.array(F.struct(F.lit("CRA").alias("role"), F.lit("Old").alias("company")))
    role = F.expr("CASE n_nationkey % 3 WHEN 0 THEN ' cra ' WHEN 1 THEN 'Lead' ELSE '' END")
    return read(spark, sf, "nation").select(c("n_nationkey").alias("id"), F.size(state.add_history(h, role, F.lit("OLD"))).alias("n"))


@query("A14_A14b_post_deals", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\bipo\\b|initial public offering') THEN 'ipo' WHEN regexp_matches(lower(text), 'acqui(re|sition)') THEN 'acquisition' WHEN regexp_matches(lower(text), 'merg(e|er|ing)\\b') THEN 'merger' WHEN regexp_matches(lower(text), 'partner(ship)?|collaborat|licens') THEN 'partnership' END AS deal FROM documents")
def a14(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.post_deal(c("text")).alias("deal"))


@query("A26_L10_moved_contacts", "SELECT 'buyers' AS t, count(*) AS n FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'candidates', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey NOT IN (SELECT n_nationkey FROM nation))")
def a26(spark, sf):
    a = read(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("original_email"))
    b = read(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("email"))
    left, right = state.move_rows(a, b, a.filter("id % 4 = 0").select("id"), {"original_email": "email"})
    n = lambda df, t: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
    return n(left, "buyers").union(n(right, "candidates"))


@query("L6_plain_feed", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click'")
def l6(spark, sf):
    return read(spark, sf, "events").filter("event_type = 'click'").select("event_id", "event_type", "user_id")


def _sql_l17() -> str:
    from tidewater.plans.q_text import _HEADLINES, _sql_amount, _sql_headline, sql_cut, sql_strip

    deal = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), {q(p)}) THEN {q(n)}" for n, p in R.HEADLINE_DEALS) + " END"
    plain = f"lower({sql_strip(sql_cut('company_name', '(?i)' + R.EXCLUSION_SUFFIX + '$'))})"
    return (
        f"WITH h AS (SELECT {_HEADLINES} AS title, 'https://n/' || o_orderkey AS source_url FROM orders), d AS (SELECT *, {deal} AS deal, {_sql_headline('title')} AS company_name FROM h) "
        f"SELECT company_name, source_url, deal, {_sql_amount('title')} AS amount FROM d WHERE deal <> 'ma' AND NOT {sql_has('title', R.NON_US_ENTITY, True)} AND NOT {sql_has('company_name', R.ACADEMIC_FUNDING)} "
        f"AND NOT {sql_has('company_name', R.VC_FUND)} AND NOT ({plain} <> '' AND (starts_with({plain}, 'alpha') OR starts_with('alpha', {plain}))) AND lower(company_name) <> 'zeta bio'"
    )


@query("L17_headline_signals", _sql_l17())
def l17(spark, sf):
    from tidewater.plans import agents
    from tidewater.plans.q_text import _HEADLINES

    cards = read(spark, sf, "orders").selectExpr(f"{_HEADLINES.replace(chr(39) * 2, chr(92) + chr(39))} AS title", "'https://n/' || o_orderkey AS article_url")
    gone = view(spark, sf, "clients").filter("rank = 1").select(F.lit("Alpha").alias("name"))
    rules = spark.createDataFrame([("funding_new_award", "company", "ZETA Bio", True), ("funding_renewal", "company", "Delta", True)], "signal_type string, rule_type string, rule_value string, auto_exclude boolean")
    return agents.headline_signals(cards, True, gone, rules).select("company_name", "source_url", "deal", "amount")


@query("J9_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def j9(spark, sf):
    from tidewater.streaming.ingest import windowed_counts

    e = read(spark, sf, "events").withColumn("at", c("ts").cast("timestamp"))
    return windowed_counts(e, "at", "event_type").withColumn("start", c("start").cast("timestamp_ntz"))


assert R and q and sql_has and resolve
