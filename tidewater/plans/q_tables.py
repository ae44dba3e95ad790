"""Queries of predicates, sorts, sets and sources over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.operators import tables as O
from tidewater.plans.registry import query
from tidewater.plans.views import cte, read, view

c = F.col


@query("A1_full_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a1(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("A1b_filtered_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def a1b(spark, sf):
    return read(spark, sf, "lineitem").filter((c("l_returnflag") == "R") & (c("l_quantity") >= 45)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("A11_lookback_scan", cte("filings") + "SELECT id, filing_date FROM filings WHERE filing_date >= (SELECT max(filing_date) FROM filings) - INTERVAL 30 DAY")
def a11(spark, sf):
    f = view(spark, sf, "filings")
    last = f.agg(F.max("filing_date").alias("last"))
    return f.join(F.broadcast(last)).filter(c("filing_date") >= F.date_sub("last", 30)).select("id", "filing_date")


@query("A19_seed_when_few", """WITH seed AS (SELECT * FROM (VALUES ('AFRICA'), ('Atlantis')) v(name)), n AS (SELECT count(*) AS n FROM region)
SELECT coalesce(r.r_name, seed.name) AS name, seed.name IS NOT NULL OR r_regionkey > 0 AS is_active FROM region r FULL JOIN (SELECT seed.name FROM seed, n WHERE n.n < 30) seed ON lower(r.r_name) = lower(seed.name)""")
def a19(spark, sf):
    r = read(spark, sf, "region")
    few = r.agg(F.count(F.lit(1)).alias("n")).filter("n < 30")
    seed = spark.range(1).select(F.explode(F.array(F.lit("AFRICA"), F.lit("Atlantis"))).alias("seed")).join(few).drop("n")
    j = r.join(seed, F.lower("r_name") == F.lower("seed"), "full_outer")
    return j.select(F.coalesce("r_name", "seed").alias("name"), (c("seed").isNotNull() | (c("r_regionkey") > 0)).alias("is_active"))


@query("A22_insert_absent", "SELECT n_name AS name FROM nation UNION ALL SELECT min(c_mktsegment) FROM customer WHERE lower(trim(c_mktsegment)) NOT IN (SELECT lower(trim(n_name)) FROM nation) GROUP BY lower(trim(c_mktsegment))")
def a22(spark, sf):
    old = read(spark, sf, "nation").select(c("n_name").alias("name"), F.lower(F.trim("n_name")).alias("k"))
    new = read(spark, sf, "customer").select(c("c_mktsegment").alias("name"), F.lower(F.trim("c_mktsegment")).alias("k")).distinct()
    return old.unionByName(O.insert_new(old, new, ["k"], ["name"])).select("name")


@query("A25_delete_by_key", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def a25(spark, sf):
    gone = read(spark, sf, "customer").filter("c_acctbal < 0").select(c("c_custkey").alias("o_custkey"))
    return O.delete_by_key(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"]).select("o_orderkey")


@query("A27_last_run", "SELECT user_id, max(ts) AS last_ts, arg_max(event_type, event_id) AS last_type, count(*) AS runs FROM events GROUP BY user_id")
def a27(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", "event_id").alias("last_type"), F.count(F.lit(1)).alias("runs"))


@query("A29_json_rows", """SELECT '{"key":' || r_regionkey || ',"name":"' || r_name || '"}' AS json FROM region""")
def a29(spark, sf):
    return read(spark, sf, "region").select(F.to_json(F.struct(c("r_regionkey").alias("key"), c("r_name").alias("name"))).alias("json"))


@query("B2_equality", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def b2(spark, sf):
    return read(spark, sf, "customer").filter(c("c_mktsegment") == "BUILDING").select("c_custkey")


@query("B3_inequality", cte("signals") + "SELECT id, priority_score FROM signals WHERE priority_score <> 0 AND status <> 'new'")
def b3(spark, sf):
    return view(spark, sf, "signals").filter((c("priority_score") != 0) & (c("status") != "new")).select("id", "priority_score")


@query("B4_in_list", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'error')")
def b4(spark, sf):
    return read(spark, sf, "events").filter(c("event_type").isin("purchase", "error")).select("event_id")


@query("B5_range", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def b5(spark, sf):
    return read(spark, sf, "orders").filter((c("o_totalprice") >= 100000) & (c("o_totalprice") < 200000)).select("o_orderkey")


@query("B6_null_tests", cte("directory", "signals") + "SELECT (SELECT count(*) FROM directory WHERE domain IS NULL) AS no_domain, (SELECT count(*) FROM signals WHERE priority_score IS NOT NULL) AS scored")
def b6(spark, sf):
    a = view(spark, sf, "directory").agg(F.count_if(c("domain").isNull()).alias("no_domain"))
    return a.join(view(spark, sf, "signals").agg(F.count("priority_score").alias("scored")))


@query("B7_null_or_empty_array", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def b7(spark, sf):
    items = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(c("l_returnflag") == "R", "R")).alias("items"))
    o = read(spark, sf, "orders").join(items, c("o_orderkey") == c("l_orderkey"), "left")
    return o.filter(c("items").isNull() | (F.size("items") == 0)).select("o_orderkey")


@query("B8_ilike_pattern", "SELECT p_partkey FROM part WHERE p_type ILIKE '_%o_o%'")
def b8(spark, sf):
    return read(spark, sf, "part").filter(O.like_any_case(c("p_type"), "_%o_o%")).select("p_partkey")


@query("B9_contains_and_prefix", cte("directory") + "SELECT id, name FROM directory WHERE name ILIKE '%bio%' OR name ILIKE 'acme%'")
def b9(spark, sf):
    return view(spark, sf, "directory").filter(c("name").ilike("%bio%") | c("name").ilike("acme%")).select("id", "name")


@query("B10_json_path", "SELECT event_id, CAST(props::JSON->>'k' AS INTEGER) AS k FROM events WHERE (props::JSON->>'k') IS NOT NULL AND CAST(props::JSON->>'k' AS INTEGER) > 90")
def b10(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf, "events").filter(k > 90).select("event_id", k.alias("k"))


_ITEMS = "WITH i AS (SELECT l_orderkey AS id, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS items FROM lineitem GROUP BY l_orderkey) "


def _items(spark, sf):
    return read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("items"))


@query("B11_array_contains", _ITEMS + "SELECT id, array_to_string(items, ',') AS items FROM i WHERE list_contains(items, 'R')")
def b11(spark, sf):
    return _items(spark, sf).filter(F.array_contains("items", "R")).select("id", F.array_join("items", ",").alias("items"))


@query("B12_array_overlap", _ITEMS + "SELECT id FROM i WHERE list_has_any(items, ['A', 'N'])")
def b12(spark, sf):
    return _items(spark, sf).filter(O.overlaps(c("items"), F.array(F.lit("A"), F.lit("N")))).select("id")


@query("B13_count_only", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'")
def b13(spark, sf):
    return read(spark, sf, "lineitem").filter(c("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).agg(F.count("*").alias("n"))


@query("B15_newest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 50")
def b15(spark, sf):
    return read(spark, sf, "orders").orderBy(c("o_totalprice").desc_nulls_first(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("B16_page", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def b16(spark, sf):
    return O.in_range(read(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 100, 149)


@query("B17_single", "SELECT n_name FROM nation WHERE n_nationkey = 7")
def b17(spark, sf):
    return O.exactly_one(read(spark, sf, "nation").filter("n_nationkey = 7").select("n_name"))


@query("B18_embedded_row", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def b18(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"), "left").select("n_nationkey", F.struct("n_name", "r_name").alias("nation"))
    return read(spark, sf, "customer").join(n, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "nation.n_name", "nation.r_name")


# aggregates


@query("E1_count_per_key", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def e1(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("E2_count_per_element", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w")
def e2(spark, sf):
    return read(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("E3_company_summary", cte("filings") + ", s AS (SELECT company_id, count(*) FILTER (form = '8-K') AS ma_count, count(*) FILTER (form = 'S-1') AS ipo_count, count(*) AS total_count FROM filings GROUP BY company_id) SELECT * FROM s")
def e3(spark, sf):
    return view(spark, sf, "filings").groupBy("company_id").agg(F.count_if(c("form") == "8-K").alias("ma_count"), F.count_if(c("form") == "S-1").alias("ipo_count"), F.count(F.lit(1)).alias("total_count"))


@query("E4_grand_totals", "SELECT count(*) AS n, round(sum(o_totalprice), 0)::BIGINT AS total, count(DISTINCT o_custkey) AS companies FROM orders WHERE o_orderstatus <> 'F'")
def e4(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus <> 'F'").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total"), F.count_distinct("o_custkey").alias("companies"))


@query("E6_stage_pivot", "SELECT o_orderpriority AS owner, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def e6(spark, sf):
    n = lambda s, a: F.count_if(c("o_orderstatus") == s).alias(a)
    return read(spark, sf, "orders").groupBy(c("o_orderpriority").alias("owner")).agg(n("O", "open"), n("F", "closed"), n("P", "pending"))


@query("E7_change_counts", """WITH t AS (SELECT conv_id, turn, lower(trim(coalesce(role, ''))) AS role, lower(trim(coalesce(text, ''))) AS text FROM conversations)
SELECT count(*) FILTER (a.role <> b.role) AS role_changed, count(*) FILTER (a.text <> b.text) AS text_changed, count(*) FILTER (a.role <> b.role OR a.text <> b.text) AS changed FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1""")
def e7(spark, sf):
    low = lambda x: F.lower(F.trim(F.coalesce(c(x), F.lit(""))))
    t = read(spark, sf, "conversations").select("conv_id", "turn", low("role").alias("role"), low("text").alias("text"))
    b = t.select("conv_id", (c("turn") - 1).alias("turn"), c("role").alias("role2"), c("text").alias("text2"))
    role, text = c("role") != c("role2"), c("text") != c("text2")
    return t.join(b, ["conv_id", "turn"]).agg(F.count_if(role).alias("role_changed"), F.count_if(text).alias("text_changed"), F.count_if(role | text).alias("changed"))


@query("E8_latest_date", "SELECT c_mktsegment AS segment, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def e8(spark, sf):
    j = read(spark, sf, "orders").join(read(spark, sf, "customer"), c("o_custkey") == c("c_custkey"))
    return j.groupBy(c("c_mktsegment").alias("segment")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))


@query("E9_signal_stats", cte("signals") + "SELECT count(*) AS active, count(*) FILTER (first_detected_at >= (SELECT max(first_detected_at) FROM signals) - INTERVAL 1 DAY) AS new_today, count(*) FILTER (status = 'carried_forward') AS carried FROM signals WHERE status IN ('new', 'carried_forward')")
def e9(spark, sf):
    s = view(spark, sf, "signals")
    last = s.agg(F.max("first_detected_at").alias("last"))
    live = s.filter(c("status").isin("new", "carried_forward")).join(F.broadcast(last))
    return live.agg(F.count(F.lit(1)).alias("active"), F.count_if(c("first_detected_at") >= c("last") - F.expr("INTERVAL 1 DAY")).alias("new_today"), F.count_if(c("status") == "carried_forward").alias("carried"))


@query("E11_distinct_ids", "SELECT DISTINCT l_suppkey FROM lineitem")
def e11(spark, sf):
    return read(spark, sf, "lineitem").select("l_suppkey").distinct()


@query("E12_newness", "SELECT event_type AS source, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS fresh, count(*) AS n FROM events GROUP BY event_type")
def e12(spark, sf):
    e = read(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).groupBy(c("event_type").alias("source")).agg(F.count_if(c("ts") >= c("last") - F.expr("INTERVAL 7 DAYS")).alias("fresh"), F.count(F.lit(1)).alias("n"))


@query("E13_histogram", "SELECT o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def e13(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(c("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("E14_first_rule_counts", cte("signals") + "SELECT CASE WHEN status = 'dismissed' THEN 'dismissed' WHEN priority_score IS NULL THEN 'unscored' WHEN priority_score < 10 THEN 'weak' ELSE 'kept' END AS rule, count(*) AS n FROM signals GROUP BY 1")
def e14(spark, sf):
    rule = F.when(c("status") == "dismissed", "dismissed").when(c("priority_score").isNull(), "unscored").when(c("priority_score") < 10, "weak").otherwise("kept")
    return view(spark, sf, "signals").groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("E16_group_to_list", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def e16(spark, sf):
    return read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


# windows


@query("F1_keep_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def f1(spark, sf):
    return O.keep_first(read(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("F2_keep_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def f2(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


@query("F3_older_copies", cte("signals") + "SELECT id FROM signals QUALIFY row_number() OVER (PARTITION BY split_part(source_url, '?', 1) ORDER BY first_detected_at DESC, id DESC) > 1")
def f3(spark, sf):
    s = view(spark, sf, "signals").withColumn("u", F.regexp_replace("source_url", r"\?[^#]*", ""))
    kept = s.groupBy("u").agg(F.max(F.struct("first_detected_at", "id")).alias("k")).select(c("k.id").alias("id"))
    return s.select("id").join(kept, "id", "left_anti")


@query("F4_caps", """WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem WHERE l_quantity > 25 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5)
SELECT l_orderkey, l_linenumber, l_suppkey FROM a ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""")
def f4(spark, sf):
    order = [c("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]
    some = O.top_per_key(read(spark, sf, "lineitem").filter("l_quantity > 25"), ["l_suppkey"], order, 5)
    return some.orderBy(*order).limit(100).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("F5_first_then_filter", "SELECT o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3) WHERE o_orderstatus = 'O'")
def f5(spark, sf):
    return O.top_per_key(read(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], 3).filter("o_orderstatus = 'O'").select("o_orderkey")


@query("F8_first_seen_upgraded", cte("directory") + "SELECT country, arg_min(id, (domain IS NULL)::INT * 1000000000 + id) AS id FROM directory GROUP BY country")
def f8(spark, sf):
    d = view(spark, sf, "directory")
    return d.groupBy("country").agg(F.min(F.struct(c("domain").isNull(), "id")).alias("b")).select("country", "b.id")


@query("F9_rotating_keyword", "SELECT n_nationkey, ['CRA', 'CTM', 'CRC', 'PV', 'QA', 'RWE', 'SAS', 'EDC'][(row_number() OVER (ORDER BY n_name) % 8 + 1)::INT] AS keyword FROM nation")
def f9(spark, sf):
    from pyspark.sql import Window

    words = F.array(*map(F.lit, ("CRA", "CTM", "CRC", "PV", "QA", "RWE", "SAS", "EDC")))
    n = F.row_number().over(Window.orderBy("n_name"))
    return read(spark, sf, "nation").select("n_nationkey", F.element_at(words, n % 8 + 1).alias("keyword"))


@query("F11_batch_slice", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def f11(spark, sf):
    return O.in_range(read(spark, sf, "part").select("p_partkey"), ["p_partkey"], 40, 59)


# sorts: the rank shows the order


@query("G1_score_order", cte("signals") + "SELECT id, priority_score, row_number() OVER (ORDER BY priority_score DESC NULLS FIRST, id) AS rank FROM signals WHERE status = 'new'")
def g1(spark, sf):
    new = view(spark, sf, "signals").filter("status = 'new'").select("id", "priority_score")
    return O.ranked(new, [c("priority_score").desc_nulls_first(), c("id")])


@query("G2_news_order", """WITH n AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS d, ts FROM events)
SELECT id, row_number() OVER (ORDER BY d IS NULL, d DESC, CASE WHEN d IS NULL THEN ts END DESC, id) AS rank FROM n""")
def g2(spark, sf):
    n = read(spark, sf, "events").select(c("event_id").alias("id"), F.when(c("event_id") % 3 != 0, c("ts").cast("date")).alias("d"), "ts")
    return O.ranked(n, [c("d").isNull(), c("d").desc(), F.when(c("d").isNull(), c("ts")).desc(), c("id")]).select("id", "rank")


@query("G6_names_in_order", cte("directory") + "SELECT name, row_number() OVER (ORDER BY name) AS rank FROM (SELECT DISTINCT name FROM directory)")
def g6(spark, sf):
    return O.ranked(view(spark, sf, "directory").select("name").distinct(), ["name"])


@query("G8_oldest", "SELECT source, min(doc_id) AS oldest FROM documents GROUP BY source")
def g8(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("oldest"))


# sets


@query("H1_tagged_union", cte("filings") + "SELECT id, '8-K' AS source, kind FROM filings WHERE form = '8-K' UNION ALL SELECT id, 'S-1', 'IPO' FROM filings WHERE form = 'S-1'")
def h1(spark, sf):
    f = view(spark, sf, "filings")
    return O.union_tagged({"8-K": f.filter("form = '8-K'").select("id", "kind"), "S-1": f.filter("form = 'S-1'").select("id", F.lit("IPO").alias("kind"))}, "source")


@query("H3_union_distinct", "SELECT lower(c_mktsegment) AS name FROM customer UNION SELECT lower(n_name) FROM nation")
def h3(spark, sf):
    return read(spark, sf, "customer").select(F.lower("c_mktsegment").alias("name")).union(read(spark, sf, "nation").select(F.lower("n_name"))).distinct()


@query("H4_except_by_key", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def h4(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("H6_array_union", "SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list_append(list(DISTINCT l_returnflag), 'Lead'))), ',') AS tags FROM lineitem GROUP BY 1")
def h6(spark, sf):
    return _items(spark, sf).select("id", F.array_join(F.array_sort(F.array_union("items", F.array(F.lit("Lead")))), ",").alias("tags"))


assert R
