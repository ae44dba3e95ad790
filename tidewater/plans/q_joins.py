"""Queries of joins and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions import scores as S
from tidewater.functions import text as T
from tidewater.operators import dedup, resolve, state
from tidewater.operators import tables as O
from tidewater.plans.q_text import q, sql_clean, sql_client, sql_cut, sql_strip, sql_words
from tidewater.plans.registry import query
from tidewater.plans.views import cte, read, view

c = F.col
_SIZE = "coalesce(try_cast(nullif(regexp_extract(replace(size, ',', ''), '(\\d+)', 1), '') AS BIGINT), 0)"
#: Names to resolve: suppliers under spellings that differ from the directory's.
_NAMES = "CASE s_suppkey % 5 WHEN 0 THEN 'ACME ' || (s_suppkey * 8) || ' INC' WHEN 1 THEN (s_suppkey * 8 + 1) || ' Therapeutics Beta' WHEN 2 THEN 'zeta ' || s_suppkey || ' /CA/' WHEN 3 THEN 'Nobody ' || s_suppkey ELSE 'The Gamma ' || (s_suppkey * 2) || ' LLC' END"


def _names(spark, sf):
    return read(spark, sf, "supplier").selectExpr("s_suppkey AS id", f"{_NAMES} AS company_name")


_BEST = f", dx AS (SELECT name, {_SIZE} AS s, {sql_clean('name')} AS e FROM directory), dk AS (SELECT *, CASE WHEN len({sql_words('e')}) >= 2 THEN array_to_string(list_sort({sql_words('e')}), '|') END AS k FROM dx), by_e AS (SELECT e, name FROM dk WHERE e <> '' QUALIFY row_number() OVER (PARTITION BY e ORDER BY s DESC, name) = 1), by_k AS (SELECT k, name FROM dk WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, name) = 1), n AS (SELECT s_suppkey AS id, {_NAMES} AS company_name FROM supplier), ne AS (SELECT *, {sql_clean('company_name')} AS e FROM n), nk AS (SELECT *, CASE WHEN len({sql_words('e')}) >= 2 THEN array_to_string(list_sort({sql_words('e')}), '|') END AS k FROM ne) "


@query("D1_left_join", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def d1(spark, sf):
    return read(spark, sf, "events").join(read(spark, sf, "customer"), c("user_id") == c("c_custkey"), "left").select("event_id", "c_mktsegment")


@query("D2_strict_match", cte("directory") + _BEST + "SELECT id, company_name, coalesce(by_e.name, by_k.name) AS matched_name, CASE WHEN by_e.name IS NOT NULL THEN 'exact_name' WHEN by_k.name IS NOT NULL THEN 'keyword' END AS matched_via FROM nk LEFT JOIN by_e ON by_e.e = nk.e LEFT JOIN by_k ON by_k.k = nk.k")
def d2(spark, sf):
    return resolve.match_company(_names(spark, sf), view(spark, sf, "directory"))


_ALT = "(SELECT DISTINCT lower(trim('NOBODY ' || s_suppkey)) AS a, 'Directory ' || s_suppkey AS directory_name FROM supplier WHERE s_suppkey % 2 = 1)"


@query("D3_alternate_first", cte("directory") + _BEST + f"SELECT id, company_name, coalesce(alt.directory_name, by_e.name, by_k.name) AS matched_name, CASE WHEN alt.a IS NOT NULL THEN 'alternate_name' WHEN by_e.name IS NOT NULL THEN 'exact_name' WHEN by_k.name IS NOT NULL THEN 'keyword' END AS matched_via FROM nk LEFT JOIN {_ALT} alt ON alt.a = lower(trim(company_name)) LEFT JOIN by_e ON by_e.e = nk.e LEFT JOIN by_k ON by_k.k = nk.k")
def d3(spark, sf):
    alt = read(spark, sf, "supplier").filter("s_suppkey % 2 = 1").selectExpr("'NOBODY ' || s_suppkey AS alternate_name", "'Directory ' || s_suppkey AS directory_name")
    return resolve.match_company(_names(spark, sf), view(spark, sf, "directory"), alternates=alt)


_SPONSORS = "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Acme ' || s_suppkey WHEN 1 THEN 'Epsilon Clinical' WHEN 2 THEN 'zeta ' || (s_suppkey % 50) || ' Inc.' ELSE 'Unknown ' || s_suppkey END AS sponsor, CASE WHEN s_suppkey % 6 = 0 THEN 'j@c' || s_suppkey || '.example.com' ELSE 'j@gmail.com' END AS email FROM supplier"


def _sql_sponsor() -> str:
    d = f"d AS (SELECT name, lower(trim(domain)) AS dom, {sql_clean('name', state=False)} AS e, {_SIZE} AS s FROM directory), dd AS (SELECT *, {sql_words('e', ())} AS w0, {sql_words('e', R.SPONSOR_STOP_WORDS)}[1] AS w FROM d WHERE e <> '')".replace("w NOT IN ()", "true")
    s = f"s AS ({_SPONSORS}), sx AS (SELECT *, {sql_clean('sponsor', state=False)} AS e, CASE WHEN email NOT LIKE '%gmail.com' THEN split_part(email, '@', 2) END AS dom FROM s), sw AS (SELECT *, ({sql_words('e', R.SPONSOR_STOP_WORDS)})[1:2] AS core FROM sx)"
    one = "n1 AS (SELECT dom, name FROM dd WHERE dom <> '' QUALIFY row_number() OVER (PARTITION BY dom ORDER BY s DESC, NOT (len(list_filter(w0, lambda x: length(x) >= 3 AND contains(dom, x))) > 0), name) = 1)"
    two = "n2 AS (SELECT e, name FROM dd QUALIFY row_number() OVER (PARTITION BY e ORDER BY s DESC, name) = 1)"
    three = "n3 AS (SELECT sw.id, dd.name FROM sw JOIN dd ON dd.w = sw.core[1] AND (CASE WHEN len(core) = 1 AND length(core[1]) <= 4 THEN dd.e = core[1] ELSE starts_with(dd.e, core[1]) END) QUALIFY row_number() OVER (PARTITION BY sw.id ORDER BY NOT starts_with(dd.e, array_to_string(core, ' ')), s DESC, dd.name) = 1)"
    return cte("directory") + f", {d}, {s}, {one}, {two}, {three} SELECT sw.id, sponsor, coalesce(n1.name, n2.name, n3.name, sponsor) AS matched_name, CASE WHEN n1.name IS NOT NULL THEN 'email_domain' WHEN n2.name IS NOT NULL THEN 'exact_name' WHEN n3.name IS NOT NULL THEN 'keyword' ELSE 'no_match' END AS matched_via FROM sw LEFT JOIN n1 ON n1.dom = sw.dom LEFT JOIN n2 ON n2.e = sw.e LEFT JOIN n3 ON n3.id = sw.id"


@query("D4_sponsor_match", _sql_sponsor())
def d4(spark, sf):
    expr = _SPONSORS.removeprefix("SELECT ").removesuffix(" FROM supplier")
    s = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS id", *[x + " END AS " + n for x, n in (("CASE s_suppkey % 4 WHEN 0 THEN 'Acme ' || s_suppkey WHEN 1 THEN 'Epsilon Clinical' WHEN 2 THEN 'zeta ' || (s_suppkey % 50) || ' Inc.' ELSE 'Unknown ' || s_suppkey", "sponsor"), ("CASE WHEN s_suppkey % 6 = 0 THEN 'j@c' || s_suppkey || '.example.com' ELSE 'j@gmail.com'", "email"))])
    assert expr
    return resolve.match_sponsor(s.select("id", "sponsor", F.array("email").alias("emails")), view(spark, sf, "directory")).drop("emails")


_TITLE5 = "CASE c_custkey % 5 WHEN 0 THEN 'Acme ' || (c_custkey + 8 - c_custkey % 8) || ' raises money' WHEN 1 THEN 'Zeta ' || (c_custkey % 50) || ': news from alt-' || (c_custkey % 30) WHEN 2 THEN 'All about alt-' || (c_custkey % 30) || 'x' WHEN 3 THEN 'nothing' ELSE 'Acme ' || (c_custkey + 8 - c_custkey % 8) || 'x is near alt-' || (c_custkey % 30) END"
_NEWS5 = f"""t AS (SELECT c_custkey AS id, lower({_TITLE5}) AS t FROM customer), names AS (SELECT DISTINCT name FROM directory),
one AS (SELECT name, lower({sql_clean(sql_strip('name'), state=False, passes=4, lower=False)}) AS x FROM names), o AS (SELECT * FROM one WHERE length(x) >= 3 AND x NOT IN ({', '.join(map(q, R.GENERIC_TERMS))})),
two AS (SELECT DISTINCT 'alt-' || (s_suppkey % 30) AS x, 'Alt Company ' || (s_suppkey % 30) AS name FROM supplier),
a AS (SELECT id, 1 AS layer, 0 AS at, -length(x) AS long, name FROM t JOIN o ON starts_with(t, x) AND NOT regexp_matches(substr(t, length(x) + 1, 1), '[a-z0-9]')),
b AS (SELECT id, 2 AS layer, list_position(list_distinct(regexp_extract_all(t, '[a-z0-9]+')), 'alt') AS at, -length(x) AS long, name FROM t JOIN two ON contains(t, x) AND NOT regexp_matches(substr(t, strpos(t, x) + length(x), 1), '[a-z0-9]') AND NOT (strpos(t, x) > 1 AND regexp_matches(substr(t, strpos(t, x) - 1, 1), '[a-z0-9]'))),
f AS (SELECT id, lower(name) AS l, min(struct_pack(layer := layer, at := 0, long := long, name := name)) AS b FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)"""


@query("D5_title_match", cte("directory") + f", {_NEWS5} SELECT t.id, string_agg(b.name, '|' ORDER BY b) AS matched_names FROM t LEFT JOIN f ON f.id = t.id GROUP BY t.id")
def d5(spark, sf):
    t = read(spark, sf, "customer").selectExpr("c_custkey AS id", f"{_TITLE5} AS title")
    alt = read(spark, sf, "supplier").selectExpr("'ALT-' || (s_suppkey % 30) AS alternate_name", "'Alt Company ' || (s_suppkey % 30) AS directory_name")
    return resolve.match_titles(t, view(spark, sf, "directory"), alt).select("id", F.array_join("matched_names", "|").alias("matched_names"))


_EXCL = f"lower({sql_strip(sql_cut('name', '(?i)' + R.EXCLUSION_SUFFIX + '$'))})"


@query("D6_C16_excluded", cte("directory", "clients") + f", n AS (SELECT DISTINCT name, {_EXCL} AS a FROM directory), e AS (SELECT DISTINCT {_EXCL} AS b FROM clients WHERE rank % 3 = 0) SELECT DISTINCT name FROM n JOIN e ON a <> '' AND b <> '' AND (starts_with(a, b) OR starts_with(b, a))")
def d6(spark, sf):
    return resolve.excluded(view(spark, sf, "directory"), view(spark, sf, "clients").filter("rank % 3 = 0"))


@query("D7_C17_dismissed", "SELECT DISTINCT event_id AS id FROM events WHERE (event_type = 'error' AND user_id % 10 = 3) OR (event_type = 'view' AND user_id % 7 = 2)")
def d7(spark, sf):
    items = read(spark, sf, "events").selectExpr("event_id AS id", "event_type AS signal_type", "'Company ' || (user_id % 10) AS company", "'Role ' || (user_id % 7) AS role_title", "CAST(NULL AS STRING) AS location")
    rules = spark.range(1).selectExpr("stack(3, 'error', 'company', 'COMPANY 3', true, 'view', 'role_title', 'role 2', true, 'click', 'company', 'company 1', false) AS (signal_type, rule_type, rule_value, auto_exclude)")
    return resolve.dismissed(items, rules, "id", "signal_type")


@query("D8_C15_size_filter", cte("directory", "clients") + "SELECT id, name FROM directory WHERE coalesce(size, '') NOT IN ('10,001+ employees', '10,001+') OR lower(trim(name)) IN (SELECT lower(trim(name)) FROM clients)")
def d8(spark, sf):
    client = view(spark, sf, "clients").select(F.lower(F.trim("name")).alias("k")).distinct().withColumn("is_client", F.lit(True))
    d = view(spark, sf, "directory").withColumn("k", F.lower(F.trim("name"))).join(client, "k", "left")
    return d.filter(~F.coalesce(c("size"), F.lit("")).isin(*R.BIG_LABELS) | c("is_client")).select("id", "name")


def _sql_fuzzy() -> str:
    esc = lambda k: f"'(^|[^a-z0-9_])' || regexp_escape({k}) || '([^a-z0-9_]|$)'"
    all_in = lambda kw, ws, plain: f"(len({kw}) > 0 AND len({ws}) > 0 AND len(list_filter({kw}, lambda k: NOT (CASE WHEN length(k) <= 4 THEN regexp_matches({plain}, {esc('k')}) ELSE list_contains({ws}, k) END))) = 0)"
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    return cte("directory", "clients") + f""", cl AS (SELECT name AS client, rank, lower(trim(name)) AS x, {sql_client('name')} AS p FROM clients WHERE is_active), cw AS (SELECT *, {words('p')} AS w FROM cl),
n AS (SELECT DISTINCT name, lower(trim(name)) AS nx, {sql_client('name')} AS np FROM directory), nw AS (SELECT *, {words('np')} AS nw FROM n),
j AS (SELECT name, client, rank, CASE WHEN x = nx THEN 1 WHEN p = np AND p <> '' THEN 2 WHEN {all_in('w', 'nw', 'np')} OR {all_in('nw', 'w', 'p')} THEN 3 END AS layer FROM nw, cw)
SELECT name, client, rank, (CASE WHEN rank <= 18 THEN floor(15 - (rank - 1) / 17.0 * 5 + 0.5) ELSE 8 END)::BIGINT AS boost FROM j WHERE layer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY layer, rank) = 1"""


@query("D9_fuzzy_clients", _sql_fuzzy())
def d9(spark, sf):
    return resolve.match_clients(view(spark, sf, "directory"), view(spark, sf, "clients"))


@query("D10_merge", "SELECT coalesce(a.c_custkey, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.c_mktsegment END AS v FROM customer a FULL JOIN (SELECT s_suppkey * 20 AS k, s_name AS v FROM supplier) b ON a.c_custkey = b.k")
def d10(spark, sf):
    old = read(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_mktsegment").alias("v"))
    new = read(spark, sf, "supplier").select((c("s_suppkey") * 20).alias("k"), c("s_name").alias("v"))
    return O.merge(old, new, ["k"])


@query("D10_merge_existing_wins", "SELECT coalesce(a.c_custkey, b.k) AS k, CASE WHEN a.c_custkey IS NOT NULL THEN a.c_mktsegment ELSE b.v END AS v FROM customer a FULL JOIN (SELECT s_suppkey * 20 AS k, s_name AS v FROM supplier) b ON a.c_custkey = b.k")
def d10b(spark, sf):
    old = read(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_mktsegment").alias("v"))
    new = read(spark, sf, "supplier").select((c("s_suppkey") * 20).alias("k"), c("s_name").alias("v"))
    return O.merge(old, new, ["k"], incoming_wins=False)


@query("D11_unseen_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def d11(spark, sf):
    seen = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(seen, "l_orderkey", "left_anti")


@query("D12_unseen_signals", cte("signals") + ", s AS (SELECT id, company_id, signal_type, split_part(source_url, '?', 1) AS u FROM signals) SELECT id FROM s a WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.id % 2 = 1 AND a.company_id = b.company_id AND a.signal_type = b.signal_type AND a.u = b.u)")
def d12(spark, sf):
    s = view(spark, sf, "signals").select("id", "company_id", "signal_type", T.job_url(c("source_url")).alias("u"))
    old = s.filter("id % 2 = 1").select("company_id", "signal_type", "u")
    return s.filter("id % 2 = 0").join(old, ["company_id", "signal_type", "u"], "left_anti").select("id")


@query("D13_json_keyed_dedup", "SELECT event_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND p.user_id = v.user_id AND (p.props::JSON->>'k') = (v.props::JSON->>'k'))")
def d13(spark, sf):
    """A user's key inside the JSON that has been seen in the last ten days."""
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    last = e.agg(F.max("ts")).first()[0]
    seen = e.filter((c("event_type") == "purchase") & (c("ts") >= F.lit(last) - F.expr("INTERVAL 10 DAYS"))).select("user_id", "k").distinct()
    return e.filter("event_type = 'view'").join(seen, ["user_id", "k"], "left_anti").select("event_id")


@query("D14_client_to_directory", cte("directory", "clients") + f", x AS (SELECT DISTINCT name AS client, lower(trim(name)) AS a, {sql_clean('name', state=False, passes=4)} AS p FROM clients), d1 AS (SELECT lower(trim(name)) AS k, max(name) AS v FROM directory GROUP BY 1), d3 AS (SELECT {sql_clean('name', state=False, passes=4)} AS k, max(name) AS v FROM directory GROUP BY 1) SELECT client, coalesce(d1.v, d3.v) AS matched_name, CASE WHEN d1.v IS NOT NULL THEN 1 WHEN d3.v IS NOT NULL THEN 3 END AS layer FROM x LEFT JOIN d1 ON d1.k = a LEFT JOIN d3 ON d3.k = p AND p <> ''")
def d14(spark, sf):
    none = view(spark, sf, "directory").select(c("name").alias("alternate_name"), c("name").alias("directory_name")).filter("false")
    return resolve.match_past_to_directory(view(spark, sf, "clients"), view(spark, sf, "directory"), none)


@query("D15_domain_to_company", cte("directory") + ", r AS (SELECT lower(trim(domain)) AS domain, name, CASE WHEN coalesce(size, '') = '' THEN -1 WHEN size = 'Self-employed' THEN 1 ELSE try_cast(regexp_extract(replace(size, ',', ''), '(\\d+)', 1) AS BIGINT) END AS rank FROM directory WHERE domain <> '') SELECT domain, name AS company_name FROM r QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rank DESC, name) = 1")
def d15(spark, sf):
    return resolve.largest_by_domain(view(spark, sf, "directory"))


@query("D16_lead_fan_out", "SELECT 'order' AS feed, o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000))")
def d16(spark, sf):
    lead = read(spark, sf, "customer").filter("c_acctbal > 9000").select(c("c_custkey").alias("o_custkey"))
    o = read(spark, sf, "orders").join(lead, "o_custkey", "left_semi")
    lines = read(spark, sf, "lineitem").join(o.select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return O.union_tagged({"order": o.select(c("o_orderkey").alias("id")), "line": lines.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"))}, "feed").select("feed", "id")


def deals(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        c("o_orderkey").alias("id"), F.concat(F.lit("Company "), c("o_custkey") % 97).alias("company"), F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("Company "), c("o_custkey") % 89)).alias("acquirer"),
        F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("Target Bio "), c("o_orderkey") % 50)).alias("acquired"), F.to_json(F.struct(c("o_totalprice").alias("v"), F.when(c("o_orderkey") % 5 == 0, "x").alias("n"))).alias("detail"), c("o_orderdate").cast("timestamp").alias("at"),
    )


@query("D17_F7_fuzzy_deals")
def d17(spark, sf):
    return dedup.fuzzy_deals(deals(spark, sf))


@query("F6_near_richest", """WITH d AS (SELECT event_id AS id, user_id % 100 AS company, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS rich, date_trunc('second', ts) AS t FROM events),
k AS (SELECT *, first_value(t) OVER w AS first_at, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY company, event_type ORDER BY rich DESC, t DESC, id))
SELECT id FROM k WHERE n > 1 AND abs(floor((epoch(first_at) - epoch(t)) / 86400)) <= 7""")
def f6(spark, sf):
    d = read(spark, sf, "events").select(c("event_id").alias("id"), (c("user_id") % 100).alias("company"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("rich"), F.date_trunc("second", c("ts").cast("timestamp")).alias("at"))
    return dedup.near_richest(d, ["company", "event_type"])


@query("D18_union_of_names", "SELECT lower(trim(c_mktsegment)) AS k, min(c_mktsegment) AS name FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT n_name FROM nation) GROUP BY 1")
def d18(spark, sf):
    u = read(spark, sf, "customer").select(c("c_mktsegment").alias("name")).union(read(spark, sf, "nation").select("n_name"))
    return u.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("name").alias("name"))


@query("D19_E10_size_lookup", cte("directory") + f", d AS (SELECT name, size FROM directory WHERE size IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY {_SIZE} DESC, id) = 1) SELECT s_suppkey AS id, size AS company_size FROM supplier LEFT JOIN d ON d.name = 'Zeta ' || (s_suppkey % 60)")
def d19(spark, sf):
    best = view(spark, sf, "directory").filter("size IS NOT NULL").groupBy("name").agg(F.min(F.struct(-S.parse_size(c("size")), "id", "size")).alias("b")).select("name", c("b.size").alias("company_size"))
    s = read(spark, sf, "supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit("Zeta "), c("s_suppkey") % 60).alias("name"))
    return s.join(best, "name", "left").select("id", "company_size")


@query("D20_counts_with_default", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def d20(spark, sf):
    n = read(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, sf, "customer").join(n, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("D22_composite_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.u, b.u) AS u, coalesce(b.v, a.v) AS v FROM (SELECT lower(trim(n_name)) AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'u' END AS u, 'old' AS v FROM nation) a FULL JOIN (SELECT lower(r_name) AS k, CAST(NULL AS VARCHAR) AS u, 'new' AS v FROM region UNION ALL SELECT lower(trim(n_name)), 'u', 'new' FROM nation WHERE n_nationkey % 3 = 0) b ON a.k = b.k AND coalesce(a.u, '') = coalesce(b.u, '')")
def d22(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    old = n.select(F.lower(F.trim("n_name")).alias("k"), F.when(c("n_nationkey") % 2 == 0, "u").alias("u"), F.lit("old").alias("v"))
    new = r.select(F.lower("r_name").alias("k"), F.lit(None).cast("string").alias("u"), F.lit("new").alias("v")).union(n.filter("n_nationkey % 3 = 0").select(F.lower(F.trim("n_name")), F.lit("u"), F.lit("new")))
    return O.merge(old, new, ["k", "u"])


@query("D23_first_hit_lookup", cte("directory") + ", d AS (SELECT lower(name) AS k, min(domain) AS domain FROM directory GROUP BY 1) SELECT s_suppkey AS id, domain FROM supplier LEFT JOIN d ON k = 'zeta ' || (s_suppkey % 60)")
def d23(spark, sf):
    d = view(spark, sf, "directory").groupBy(F.lower("name").alias("k")).agg(F.min("domain").alias("domain"))
    return read(spark, sf, "supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit("zeta "), c("s_suppkey") % 60).alias("k")).join(d, "k", "left").select("id", "domain")


@query("D24_insert_with_default", "SELECT s_suppkey AS k, 'crm' AS page FROM supplier UNION ALL SELECT n_nationkey + 90, 'crm' FROM nation WHERE n_nationkey + 90 NOT IN (SELECT s_suppkey FROM supplier)")
def d24(spark, sf):
    old = read(spark, sf, "supplier").select(c("s_suppkey").alias("k"), F.lit("crm").alias("page"))
    new = read(spark, sf, "nation").select((c("n_nationkey") + 90).cast("long").alias("k"), F.lit("crm").alias("page"))
    return old.union(O.insert_new(old, new, ["k", "page"], ["k"]).select("k", "page"))


@query("D25_contact_flags", "WITH t AS (SELECT conv_id, turn, role, text FROM conversations) SELECT a.conv_id, a.turn, coalesce(lower(trim(b.text)) <> lower(trim(a.text)) AND trim(b.text) <> '', false) AS text_changed, coalesce(b.role <> a.role, false) AS role_changed FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2")
def d25(spark, sf):
    t = read(spark, sf, "conversations")
    b = t.select("conv_id", (c("turn") - 2).alias("turn"), c("role").alias("r2"), c("text").alias("t2"))
    low = lambda x: F.lower(F.trim(c(x)))
    return t.join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce((low("t2") != low("text")) & (F.trim("t2") != ""), F.lit(False)).alias("text_changed"), F.coalesce(c("r2") != c("role"), F.lit(False)).alias("role_changed"))


# state


@query("J4_L19_queue_ageing", """WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'dismissed' WHEN event_id % 7 = 0 THEN 'carried_forward' ELSE 'new' END AS status, CASE WHEN event_id % 50 = 1 THEN NULL ELSE date_trunc('second', ts) END AS t, CASE event_type WHEN 'view' THEN 0 ELSE 22 END AS strength FROM events),
m AS (SELECT (max(ts)::DATE + 1)::TIMESTAMP AS today FROM events), d AS (SELECT *, greatest(0, floor((epoch(today) - epoch(coalesce(t, today))) / 86400))::INT AS days FROM s, m WHERE status <> 'dismissed')
SELECT id, status = 'new' AND coalesce(t, today) < today AS is_carried_forward, days AS days_in_queue, least(100, coalesce(nullif(strength, 0), 17) + CASE WHEN days <= 7 THEN greatest(25 - days * 3, 10) ELSE least(10 + floor((days - 7) / 3.0), 25) END + 6)::DOUBLE AS priority_score FROM d""")
def j4(spark, sf):
    e = read(spark, sf, "events")
    today = e.agg(F.date_format(F.date_add(F.max(c("ts").cast("date")), 1), "yyyy-MM-dd")).first()[0]
    none = F.lit(None).cast("int")
    s = e.select(
        c("event_id").alias("id"), F.when(c("event_id") % 5 == 0, "dismissed").when(c("event_id") % 7 == 0, "carried_forward").otherwise("new").alias("status"), F.when(c("event_id") % 50 != 1, F.date_trunc("second", c("ts").cast("timestamp"))).alias("first_detected_at"),
        F.when(c("event_type") == "view", 0).otherwise(22).alias("strength"), F.lit(17).alias("base"), F.lit(6).alias("warmth"), none.alias("actionability"), F.lit(0).alias("boost"), none.alias("nested_boost"),
    )
    return state.age_queue(s, today).select("id", "is_carried_forward", "days_in_queue", "priority_score")


@query("J6_exclusion_state", "WITH e AS (SELECT lower(s_name) AS k, s_name AS name, 20000 AS members FROM supplier WHERE s_suppkey % 2 = 0), o AS (SELECT lower(s_name) AS k, s_name AS name, (s_suppkey * 500)::INT AS members FROM supplier WHERE s_suppkey % 3 = 0) SELECT coalesce(e.name, o.name) AS name, coalesce(o.members, e.members) AS members, coalesce(o.members >= 10001, true) AS excluded FROM e FULL JOIN o ON e.k = o.k")
def j6(spark, sf):
    s = read(spark, sf, "supplier")
    old = s.filter("s_suppkey % 2 = 0").select(c("s_name").alias("name"), F.lit(20000).alias("members"))
    return state.exclusion_update(old, s.filter("s_suppkey % 3 = 0").select(c("s_name").alias("name"), (c("s_suppkey") * 500).cast("int").alias("members")))


@query("J5_contact_update", """WITH t AS (SELECT conv_id, turn, role, text AS x FROM conversations), a AS (SELECT * FROM t WHERE turn = 0), b AS (SELECT * FROM t WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
j AS (SELECT a.conv_id, a.role AS r0, a.x AS x0, b.conv_id IS NOT NULL AS hit, b.role AS r1, b.x AS x1, lower(trim(coalesce(b.role, ''))) <> lower(trim(coalesce(a.role, ''))) AS role, lower(trim(coalesce(b.x, ''))) <> lower(trim(coalesce(a.x, ''))) AS company, lower(trim(coalesce(a.x, ''))) <> 'old co' AS differ FROM a LEFT JOIN b ON a.conv_id = b.conv_id)
SELECT conv_id::VARCHAR AS linkedin_url, r0 AS original_title, CASE WHEN hit AND (role OR company OR differ) THEN x0 ELSE 'Old Co' END AS original_company, CASE WHEN hit AND (role OR company) THEN r1 ELSE r0 END AS current_title, CASE WHEN hit AND (role OR company) THEN x1 ELSE x0 END AS current_company,
'X' AS current_location, CASE WHEN hit AND (role OR company OR differ) AND trim(coalesce(r0, '')) <> '' THEN '[{"role":"' || r0 || '","company":"Old Co"}]' ELSE '[]' END AS job_history, CASE WHEN hit THEN CASE WHEN role AND company THEN 'both_changed' WHEN role THEN 'role_changed' WHEN company THEN 'company_changed' END END AS last_change_type,
CASE WHEN hit THEN DATE '1998-08-01' END AS last_enrichment_date FROM j""")
def j5(spark, sf):
    t = read(spark, sf, "conversations")
    first = lambda n: t.filter(c("turn") == n)
    contacts = first(0).select(
        c("conv_id").cast("string").alias("linkedin_url"), c("role").alias("original_title"), F.lit("Old Co").alias("original_company"), c("role").alias("current_title"), c("text").alias("current_company"), F.lit("X").alias("current_location"),
        F.expr("CAST(array() AS array<struct<role: string, company: string>>)").alias("job_history"), F.lit(None).cast("string").alias("last_change_type"), F.lit(None).cast("date").alias("last_enrichment_date"),
    )
    last = t.filter("turn > 0").groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("b"))
    new = last.select(c("conv_id").cast("string").alias("linkedin_url"), c("b.role").alias("title"), c("b.text").alias("company"), F.lit("x").alias("location"))
    return state.update_contacts(contacts, new, "1998-08-01").withColumn("job_history", F.to_json("job_history"))
