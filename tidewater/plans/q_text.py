"""Queries of scalar functions and rules over texts made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import dates as D
from tidewater.functions import rules as R
from tidewater.functions import scores as S
from tidewater.functions import text as T
from tidewater.plans.registry import query
from tidewater.plans.views import cte, read, view

c = F.col
q = lambda s: "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


def sql_cut(x: str, p: str) -> str:
    return f"regexp_replace({x}, {q(p)}, '', 'g')"


def sql_tail(x: str) -> str:
    return sql_strip(sql_cut(x, r"[,.\s]+$"))


def sql_clean(x: str, state: bool = True, passes: int = 3, lower: bool = True) -> str:
    s = sql_cut(f"coalesce({x}, '')", r"\s*\([^)]*\)")
    if state:
        s = sql_cut(s, R.STATE + "$")
    for _ in range(passes):
        s = sql_cut(s, f"(?i){R.LEGAL}$")
    s = sql_tail(s)
    return f"lower({s})" if lower else s


def sql_client(x: str) -> str:
    s = sql_strip(f"lower(coalesce({x}, ''))")
    s = sql_tail(sql_strip(sql_cut(s, f"(?i){R.CLIENT_LEGAL}$")))
    return sql_tail(sql_strip(sql_cut(s, f"(?i){R.CLIENT_INDUSTRY}$")))


def sql_has(x: str, p: str, case: bool = False) -> str:
    return f"coalesce(regexp_matches({x}, {q(p if case else '(?i)' + p)}), false)"


def sql_words(x: str, stop=R.STOP_WORDS) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '' AND w NOT IN ({', '.join(map(q, stop))}))"


@query("I1_clean_name", cte("directory") + f"SELECT id, {sql_clean('name')} AS cleaned, {sql_clean('name', state=False)} AS cleaned_plain FROM directory")
def i1(spark, sf):
    return view(spark, sf, "directory").select("id", T.clean_name(c("name")).alias("cleaned"), T.clean_name(c("name"), state=False).alias("cleaned_plain"))


@query("I2_news_name", cte("directory") + f"SELECT id, {sql_clean(sql_strip('name'), state=False, passes=4, lower=False)} AS news_name FROM directory")
def i2(spark, sf):
    return view(spark, sf, "directory").select("id", T.news_name(c("name")).alias("news_name"))


@query("I4_client_name", cte("directory") + f"SELECT id, {sql_client('name')} AS client_name FROM directory")
def i4(spark, sf):
    return view(spark, sf, "directory").select("id", T.client_name(c("name")).alias("client_name"))


@query("I5_I6_suffixes", cte("directory") + f"SELECT id, lower({sql_strip(sql_cut('name', '(?i)' + R.EXCLUSION_SUFFIX + '$'))}) AS exclusion_name, {sql_strip(sql_cut('name', '(?i)' + R.SHORT_SUFFIX + '$'))} AS short_name FROM directory")
def i5(spark, sf):
    return view(spark, sf, "directory").select("id", T.exclusion_name(c("name")).alias("exclusion_name"), T.short_name(c("name")).alias("short_name"))


def sql_similar(x: str) -> str:
    return sql_strip(f"regexp_replace({sql_cut(sql_cut(f'lower(coalesce({x}, {q(str())}))', '[,.]'), R.SIMILAR_WORDS)}, '\\s+', ' ', 'g')")


def sql_names_similar(a: str, b: str) -> str:
    one = lambda x, y: f"(length({x}) >= 6 AND starts_with({y}, substr({x}, 1, 6)) OR length({x}) >= 8 AND contains({y}, substr({x}, 1, 8)))"
    return f"coalesce(length({a}) > 0 AND length({b}) > 0 AND ({a} = {b} OR {one(a, b)} OR {one(b, a)}), false)"


@query("I7_I8_similar_names", cte("directory") + f", x AS (SELECT id, {sql_similar('name')} AS a, {sql_similar('industry || id')} AS b, {sql_similar('name || id')} AS d FROM directory) SELECT id, a, {sql_names_similar('a', 'b')} AS like_b, {sql_names_similar('a', 'd')} AS like_d FROM x")
def i7(spark, sf):
    x = view(spark, sf, "directory").select("id", T.similar_name(c("name")).alias("a"), T.similar_name(F.concat("industry", "id")).alias("b"), T.similar_name(F.concat("name", "id")).alias("d"))
    return x.select("id", "a", T.names_similar(c("a"), c("b")).alias("like_b"), T.names_similar(c("a"), c("d")).alias("like_d"))


@query("I10_I11_word_keys", cte("directory") + f", x AS (SELECT id, {sql_clean('name')} AS n FROM directory), y AS (SELECT id, {sql_words('n')} AS w, {sql_words('n', R.SPONSOR_STOP_WORDS)} AS v FROM x) SELECT id, CASE WHEN len(w) >= 2 THEN array_to_string(list_sort(w), '|') END AS word_key, array_to_string(v[1:2], ' ') AS core FROM y")
def i10(spark, sf):
    n = T.clean_name(c("name"))
    return view(spark, sf, "directory").select("id", T.word_key(n).alias("word_key"), F.array_join(T.core_words(n), " ").alias("core"))


@query("I12_word_set", "SELECT doc_id, regexp_extract(lower(text), '[a-z0-9]+') AS first_word, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS n_words FROM documents")
def i12(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.first_word(c("text")).alias("first_word"), F.size(T.word_set(c("text"))).alias("n_words"))


_TITLES = "SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'Senior Biostatistician (Remote)' WHEN 1 THEN 'Clinical Data Manager' WHEN 2 THEN 'PV Scientist' WHEN 3 THEN 'Aircraft Mechanic' WHEN 4 THEN 'RWE Programmer, HEOR' WHEN 5 THEN '(contract)' WHEN 6 THEN 'Regulatory Affairs Manager' WHEN 7 THEN 'Sales Rep - Clinical Trial' WHEN 8 THEN 'Medical Writer II' WHEN 9 THEN 'QA Validation Intern' WHEN 10 THEN 'Chef' ELSE 'Clinical Research Associate' END || CASE WHEN p_size > 40 THEN ' - ' || p_brand ELSE '' END AS title FROM part"


def _titles(spark, sf):
    expr = _TITLES.removeprefix("SELECT p_partkey AS id, ").removesuffix(" AS title FROM part")
    return read(spark, sf, "part").selectExpr("p_partkey AS id", f"{expr} AS title")


def sql_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")" if parts else "false"


def sql_specialties(x: str) -> str:
    each = ", ".join(f"CASE WHEN {sql_any(x, a)} OR {sql_has(x, '(^|[^a-z0-9])(' + '|'.join(w) + ')([^a-z0-9]|$)') if w else 'false'} THEN {q(n)} END" for n, a, w in R.SPECIALTIES)
    return f"coalesce(nullif(array_to_string(list_filter([{each}], lambda s: s IS NOT NULL), ','), ''), 'Other')"


@query("I14_I15_specialties", f"WITH t AS ({_TITLES}), u AS (SELECT id, regexp_replace(lower(title), '\\([^)]*\\)', '', 'g') AS cleaned FROM t) SELECT id, cleaned, CASE WHEN {sql_strip('cleaned')} = '' THEN 'Other' ELSE {sql_specialties('cleaned')} END AS specialties FROM u")
def i14(spark, sf):
    return _titles(spark, sf).select("id", T.clean_title(c("title")).alias("cleaned"), F.array_join(T.specialties(c("title")), ",").alias("specialties"))


@query("C13_C14_roles", f"WITH t AS ({_TITLES}) SELECT id, {sql_has('title', T.role_pattern())} AS is_role, {sql_has('title', R.EXCLUDED_ROLES)} AS is_excluded FROM t")
def c13(spark, sf):
    return _titles(spark, sf).select("id", T.has(c("title"), T.role_pattern()).alias("is_role"), T.has(c("title"), R.EXCLUDED_ROLES).alias("is_excluded"))


_KINDS = {
    "academic_funding": (R.ACADEMIC_FUNDING, False), "academic_jobs": (R.ACADEMIC_JOBS, False), "academic_cleanup": (R.ACADEMIC_CLEANUP, False), "industry": (R.INDUSTRY, False),
    "life_sciences": (R.LIFE_SCIENCES, False), "vc_fund": (R.VC_FUND, False), "large_pharma": (R.LARGE_PHARMA, False), "non_us_entity": (R.NON_US_ENTITY, True),
    "non_us_jobs": (R.NON_US_JOBS, False), "non_us_board": (R.NON_US_BOARD, False), "cro_jobs": (R.CRO_JOBS, False), "cro_board": (R.CRO_BOARD, False),
    "consulting": (R.CONSULTING, False), "pharma": (R.PHARMA_INDICATOR, False), "garbage": (R.GARBAGE_TITLES, False),
}
_ORGS = "CASE s_suppkey % 10 WHEN 0 THEN 'Duke University' WHEN 1 THEN 'Roche Pharma plc' WHEN 2 THEN 'Acme Therapeutics GmbH, Germany' WHEN 3 THEN 'Big Ventures Fund' WHEN 4 THEN 'Medpace UK' WHEN 5 THEN 'Deloitte Consulting' WHEN 6 THEN 'Bio Institute of Ontario' WHEN 7 THEN 'VA Medical Center' WHEN 8 THEN 'Microsoft' ELSE 'Old Long Name Without Kind' END || ' ' || s_suppkey"


@query("C1_C11_name_kinds", f"WITH o AS (SELECT s_suppkey AS id, {_ORGS} AS name FROM supplier) SELECT id, " + ", ".join(f"{sql_has('name', p, case)} AS {k}" for k, (p, case) in _KINDS.items()) + f", NOT {sql_has('name', R.ACADEMIC_FUNDING)} AND ({sql_has('name', R.INDUSTRY)} OR len(regexp_split_to_array(trim(name), '\\s+')) <= 3) AS industry_filer, {sql_has('name', '[^\\x00-\\x7F]', True)} AS non_ascii FROM o")
def c1(spark, sf):
    o = read(spark, sf, "supplier").selectExpr("s_suppkey AS id", f"{_ORGS} AS name")
    filer = ~T.has(c("name"), R.ACADEMIC_FUNDING) & (T.has(c("name"), R.INDUSTRY) | (F.size(F.split(F.trim("name"), r"\s+")) <= 3))
    return o.select("id", *[T.has(c("name"), p, case).alias(k) for k, (p, case) in _KINDS.items()], filer.alias("industry_filer"), T.has(c("name"), r"[^\x00-\x7F]", True).alias("non_ascii"))


_SITE = R.CLINICAL_SITE.replace("pediatric(?!.*pharma)|", "").replace("labcorp(?!.*drug)|", "")
_TRIAL = R.ACADEMIC_TRIALS.removesuffix(r"|\bva\b(?! pharmaceuticals)")


@query("C1_C11_lookahead", f"WITH o AS (SELECT s_suppkey AS id, {_ORGS} || CASE s_suppkey % 3 WHEN 0 THEN ' Pediatric Pharma' WHEN 1 THEN ' Labcorp' ELSE ' VA Clinic' END AS name FROM supplier) SELECT id, {sql_has('name', _TRIAL)} OR regexp_matches(replace(lower(name), 'va pharmaceuticals', ''), '\\bva\\b') AS academic_trials, {sql_has('name', _SITE)} OR (regexp_matches(lower(name), 'pediatric') AND NOT regexp_matches(lower(name), 'pediatric.*pharma')) OR (regexp_matches(lower(name), 'labcorp') AND NOT regexp_matches(lower(name), 'labcorp.*drug')) AS clinical_site FROM o")
def c1b(spark, sf):
    o = read(spark, sf, "supplier").selectExpr("s_suppkey AS id", f"{_ORGS} || CASE s_suppkey % 3 WHEN 0 THEN ' Pediatric Pharma' WHEN 1 THEN ' Labcorp' ELSE ' VA Clinic' END AS name")
    return o.select("id", T.has(c("name"), R.ACADEMIC_TRIALS).alias("academic_trials"), T.has(c("name"), R.CLINICAL_SITE).alias("clinical_site"))


@query("C12_competitor_firms", f"SELECT s_suppkey FROM supplier WHERE CASE s_suppkey % 5 WHEN 0 THEN 'Kelly' WHEN 1 THEN 'kelly' WHEN 2 THEN 'Hays' ELSE s_name END IN ({', '.join(map(q, R.COMPETITORS))})")
def c12(spark, sf):
    firm = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'Kelly' WHEN 1 THEN 'kelly' WHEN 2 THEN 'Hays' ELSE s_name END")
    return read(spark, sf, "supplier").filter(firm.isin(*R.COMPETITORS)).select("s_suppkey")


# every line of every text is a paragraph; white space and word breaks are ASCII in both dialects
@query("C24_substantive", r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
t AS (SELECT doc_id, place, trim(regexp_replace(p, '[ \t\n\f\r\v]+', ' ', 'g')) AS t FROM x)
SELECT doc_id, place::INT AS place, length(t) >= 20 AND (length(t) >= 80 OR regexp_matches(lower(t), '\b(on|the|we|our|company|pursuant)\b')) AS ok FROM t""")
def c24(spark, sf):
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "p"))
    return lines.select("doc_id", (c("at") + 1).alias("place"), T.substantive(c("p")).alias("ok"))


_HEADLINES = "CASE o_orderkey % 9 WHEN 0 THEN 'Acme Raises $' || (o_orderkey % 90) || 'M in Series B' WHEN 1 THEN 'Roche-Partnered Zeta Bio Nabs $20M' WHEN 2 THEN 'China''s Gamma Files for IPO' WHEN 3 THEN 'Pfizer Bets $1.2 billion on Delta' WHEN 4 THEN 'Merck Pays $50M for SmallBio''s drug' WHEN 5 THEN 'Beta &amp; Sons in licensing pact' WHEN 6 THEN 'Alpha acquires Omega for $3,400 million' WHEN 7 THEN 'Weekly digest of the industry' ELSE 'Epsilon Joins Forces' END"


def _sql_headline(x: str) -> str:
    t = f"replace(replace(replace({x}, '&amp;', '&'), '&#039;', ''''), '&quot;', '\"')"
    forms = (
        r"(?i)^[A-Za-z\s]+-Partnered\s+(.+?)\s+(?:Raises|Nabs|Secures|Closes|Files|Completes|Nets|Snags|Debuts)\b",
        r"(?i)^(?:China|US|UK|EU|Japan|Korea|Israel|Germany|France)'s\s+(.+?)\s+(?:Raises|Nabs|Secures|Closes|Files|Joins|Signs|Nets)\b",
        r"^[A-Za-z\s]+(?:Fronts|Pays|Invests|Bets)[^f]+\s+for\s+([A-Z][A-Za-z]+(?:\s[A-Z][a-z]+)*)'s",
        r"(?i)^(.+?)\s+\b(?:Raises|Raised|Bets|Fronts|Nabs|Joins|Signs|Teams|Enters|Announces|Files|Completes|Closes|Acquires|Agrees|Inks|Secures|Lands|Wins|Dives|Keeps|Establishes|Pumps|Launches|Nets|Snags|Debuts|Goes|Steps|Forms|Jumps)\b",
    )
    return "coalesce(" + ", ".join(f"nullif({sql_strip(f'regexp_extract({t}, {q(p)}, 1)')}, '')" for p in forms) + f", array_to_string((regexp_split_to_array({t}, '\\s+'))[1:3], ' '))"


def _sql_amount(x: str) -> str:
    p = r"(?i)\$\s*(\d[\d.,]*)\s*(million|billion|M|B)\b"
    return f"CASE WHEN regexp_extract({x}, {q(p)}, 2) <> '' THEN '$' || replace(regexp_extract({x}, {q(p)}, 1), ',', '') || CASE WHEN lower(regexp_extract({x}, {q(p)}, 2)) IN ('billion', 'b') THEN 'B' ELSE 'M' END END"


@query("I20_I21_I55_headlines", f"WITH h AS (SELECT o_orderkey AS id, {_HEADLINES} AS t FROM orders) SELECT id, {_sql_headline('t')} AS company, CASE " + " ".join(f"WHEN regexp_matches(lower(t), {q(p)}) THEN {q(n)}" for n, p in R.HEADLINE_DEALS) + f" END AS deal, {_sql_amount('t')} AS amount FROM h")
def i20(spark, sf):
    h = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_HEADLINES.replace(chr(39) * 2, chr(92) + chr(39))} AS t")
    return h.select("id", T.headline_company(c("t")).alias("company"), T.headline_deal(c("t")).alias("deal"), T.amount(c("t")).alias("amount"))


_FILING = "CASE o_orderkey % 8 WHEN 0 THEN 'entered into an Agreement and Plan of Merger. The merger consideration is $2.5 billion. Big Parent Inc (the \"Parent\") will survive.' WHEN 1 THEN 'acquired global rights to LYL273 from Seller Bio, for $40 million' WHEN 2 THEN 'entered into a definitive agreement to acquire Small Target Inc. for $300 million' WHEN 3 THEN 'priced its initial public offering of shares of common stock at an offering price of $10' WHEN 4 THEN 'entered into a license agreement with Partner Labs, including royalties and collaboration agreement' WHEN 5 THEN 'signed a credit agreement with Bank One.' WHEN 6 THEN 'announced a stock purchase agreement and tender offer' ELSE 'nothing of note' END"


def sql_kind(x: str) -> str:
    comp = sql_has(x, R.COMPOUND, True)
    total = lambda each: " + ".join(f"CASE WHEN {' AND '.join([*(sql_has(x, p) for p in ps), *([] if need is None else [comp if need else 'NOT ' + comp])])} THEN {w} ELSE 0 END" for w, ps, need in each)
    lists = ", ".join(f"({total(each)})" for _, each in R.TRANSACTIONS)
    names = ", ".join(q(n) for n, _ in R.TRANSACTIONS)
    return f"(SELECT CASE WHEN list_max(s) = 0 THEN 'acquisition' ELSE list_extract([{names}], list_position(s, list_max(s))) END FROM (SELECT [{lists}] AS s))"


def sql_agreement(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(f'lower({x})', a)} AND NOT {sql_any(f'lower({x})', b)} THEN {q(n)}" for n, a, b in R.AGREEMENTS) + " ELSE 'Other' END"


@query("I22_I23_filing_kinds", f"WITH f AS (SELECT o_orderkey AS id, {_FILING} AS t FROM orders) SELECT id, {sql_kind('t')} AS kind, {sql_agreement('t')} AS agreement, {_sql_amount('t')} AS amount FROM f")
def i22(spark, sf):
    f = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_FILING} AS t")
    return f.select("id", T.transaction_kind(c("t")).alias("kind"), T.agreement_kind(c("t")).alias("agreement"), T.amount(c("t")).alias("amount"))


# whole documents, every other one with a filing's sentence behind it
_FILED = f"text || CASE WHEN doc_id % 2 = 0 THEN ' ' || {_FILING.replace('o_orderkey % 8', '(doc_id // 2) % 8')} ELSE '' END"


@query("I22_I23_document_kinds", f"WITH f AS (SELECT doc_id, {_FILED} AS t FROM documents) SELECT doc_id, {sql_kind('t')} AS kind, {sql_agreement('t')} AS agreement FROM f")
def i22d(spark, sf):
    f = read(spark, sf, "documents").selectExpr("doc_id", f"{_FILED.replace('doc_id // 2', 'doc_id DIV 2')} AS t")
    return f.select("doc_id", T.transaction_kind(c("t")).alias("kind"), T.agreement_kind(c("t")).alias("agreement"))


@query("I24_I26_deal_details")
def i24(spark, sf):
    f = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_FILING} AS t", "'Filer ' || o_custkey AS filer")
    return T.with_deal(f, "t", "filer").drop("t", "filer")


_URLS = "CASE page_id % 4 WHEN 0 THEN url || '/' WHEN 1 THEN upper(url) ELSE url || '//' END"


@query("I30_I31_I34_urls", f"SELECT page_id, regexp_replace(url, '\\?[^#]*', '') AS job_url, regexp_replace(lower(trim({_URLS})), '/+$', '') AS plain_url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def i30(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", T.job_url(c("url")).alias("job_url"), T.plain_url(F.expr(_URLS)).alias("plain_url"), T.slug(c("url")).alias("slug"))


@query("I17_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS body FROM pages")
def i17(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.strip_tags(c("html")).alias("body"))


@query("I18_links", "SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_urls FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY page_id")
def i18(spark, sf):
    links = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("href").alias("n_urls"))


@query("I33_email_domain", "WITH e AS (SELECT c_custkey AS id, ['a@gmail.com', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x@C' || c_custkey || '.ORG ' END, 'no-at', 'z@late.com'] AS emails FROM customer), d AS (SELECT id, list_filter(list_transform(emails, lambda e: CASE WHEN contains(e, '@') THEN lower(trim(regexp_extract(e, '@(.*)', 1))) END), lambda d: d IS NOT NULL AND d NOT IN ('gmail.com')) AS ds FROM e) SELECT id, ds[1] AS domain FROM d")
def i33(spark, sf):
    e = F.array(F.lit("a@gmail.com"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x@C' || c_custkey || '.ORG ' END"), F.lit("no-at"), F.lit("z@late.com"))
    return read(spark, sf, "customer").select(c("c_custkey").alias("id"), T.email_domain(e).alias("domain"))


@query("I41_week_cutoff", "SELECT event_id, date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR - INTERVAL 7 DAY AS cutoff FROM events")
def i41(spark, sf):
    return read(spark, sf, "events").select("event_id", D.week_cutoff(c("ts").cast("timestamp")).cast("timestamp_ntz").alias("cutoff"))


@query("I42_I48_dates", "WITH d AS (SELECT o_orderkey AS id, strftime(o_orderdate, 'Posted %B %-d, %Y by x') AS named, '/news/' || strftime(o_orderdate, '%Y/%-m/%-d') || '/x' AS url, o_orderdate FROM orders) SELECT id, CAST(o_orderdate AS DATE) AS named_date, CAST(o_orderdate AS DATE) AS url_date, CAST(o_orderdate AS DATE) AS iso_date FROM d")
def i42(spark, sf):
    d = read(spark, sf, "orders")
    named = F.concat(F.lit("Posted "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" by x"))
    url = F.concat(F.lit("/news/"), F.date_format("o_orderdate", "yyyy/M/d"), F.lit("/x"))
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return d.select(c("o_orderkey").alias("id"), D.named_date(named).alias("named_date"), D.url_date(url).alias("url_date"), D.iso_date(iso).alias("iso_date"))


_AGES = "CASE p_partkey % 9 WHEN 0 THEN (p_size || ' minutes ago') WHEN 1 THEN 'yesterday' WHEN 2 THEN (p_size || ' days ago') WHEN 3 THEN 'Last week' WHEN 4 THEN (p_size || ' weeks ago') WHEN 5 THEN 'last month' WHEN 6 THEN (p_size || ' months ago') WHEN 7 THEN ('Posted ' || p_size || ' days ago') ELSE 'soon' END"


@query("I43_I44_relative_dates", f"WITH a AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 9 AS k FROM part) SELECT id, CASE k WHEN 0 THEN DATE '1998-08-01' WHEN 1 THEN DATE '1998-07-31' WHEN 2 THEN DATE '1998-08-01' - n WHEN 3 THEN DATE '1998-07-25' WHEN 4 THEN DATE '1998-08-01' - n * 7 WHEN 5 THEN DATE '1998-07-02' WHEN 6 THEN DATE '1998-08-01' - n * 30 END AS at, CASE k WHEN 2 THEN n WHEN 7 THEN n WHEN 4 THEN n * 7 WHEN 6 THEN n * 30 ELSE 0 END AS days FROM a")
def i43(spark, sf):
    a = read(spark, sf, "part").selectExpr("p_partkey AS id", f"{_AGES} AS t")
    return a.select("id", D.relative_date(c("t"), F.lit("1998-08-01").cast("date")).alias("at"), D.days_posted(c("t")).alias("days"))


@query("I45_I46_ages", "SELECT event_id, greatest(0, floor((epoch(TIMESTAMP '1998-08-01') - epoch(ts)) / 86400))::BIGINT AS age, abs(floor((epoch(ts) - epoch(TIMESTAMP '1998-08-01')) / 86400))::BIGINT AS apart FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def i45(spark, sf):
    at, now = c("ts").cast("timestamp"), F.lit("1998-08-01").cast("timestamp")
    return read(spark, sf, "events").select("event_id", D.age_days(at, now).alias("age"), D.days_between(at, now).alias("apart"))


@query("I49_week_ranges", "SELECT o_orderkey AS id, len(range(0, (o_orderkey % 30)::BIGINT + 1, 7))::INT AS n_weeks FROM orders")
def i49(spark, sf):
    d = F.lit("1998-01-01").cast("date")
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.size(D.weeks(d, F.date_add(d, (c("o_orderkey") % 30).cast("int")))).alias("n_weeks"))


@query("I50_queue_score", """WITH s AS (SELECT event_id AS id, (event_id % 61 - 3)::INT AS d, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN NULL ELSE 22 END AS strength, CASE event_id % 3 WHEN 0 THEN NULL ELSE 17 END AS base, (event_id % 5)::INT AS warmth, CASE event_id % 7 WHEN 0 THEN 0 ELSE (event_id % 13)::INT END AS boost FROM events)
SELECT id, least(100, coalesce(nullif(strength, 0), nullif(base, 0), 15) + CASE WHEN d <= 7 THEN greatest(25 - d * 3, 10) ELSE least(10 + floor((d - 7) / 3.0), 25) END + warmth + coalesce(nullif(boost, 0), 9))::BIGINT AS score FROM s""")
def i50(spark, sf):
    s = read(spark, sf, "events").selectExpr("event_id AS id", "CAST(event_id % 61 - 3 AS INT) AS d", "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN NULL ELSE 22 END AS strength", "CASE event_id % 3 WHEN 0 THEN NULL ELSE 17 END AS base", "CAST(event_id % 5 AS INT) AS warmth", "CASE event_id % 7 WHEN 0 THEN 0 ELSE CAST(event_id % 13 AS INT) END AS boost")
    return s.select("id", S.queue_score(c("d"), c("strength"), c("base"), c("warmth"), F.lit(None).cast("int"), c("boost"), F.lit(9)).cast("long").alias("score"))


@query("I51_I56_scores", "SELECT s_suppkey AS id, CASE WHEN s_suppkey <= 18 THEN floor(15 - (s_suppkey - 1) / 17.0 * 5 + 0.5) ELSE 8 END::BIGINT AS boost, CASE WHEN s_suppkey % 90 >= 60 THEN 18 WHEN s_suppkey % 90 >= 30 THEN 17 ELSE 15 END AS age_score, '$' || floor(s_acctbal / 1000 + 0.5)::BIGINT || 'K' AS amount FROM supplier")
def i51(spark, sf):
    return read(spark, sf, "supplier").select(c("s_suppkey").alias("id"), S.client_boost(c("s_suppkey")).alias("boost"), S.age_score(c("s_suppkey") % 90).alias("age_score"), S.grant_amount(c("s_acctbal")).alias("amount"))


@query("I53_I54_sizes", cte("directory") + "SELECT id, coalesce(try_cast(nullif(regexp_extract(replace(size, ',', ''), '(\\d+)', 1), '') AS BIGINT), 0) AS parsed, CASE WHEN coalesce(size, '') = '' THEN -1 WHEN size = 'Self-employed' THEN 1 ELSE coalesce(try_cast(nullif(regexp_extract(replace(size, ',', ''), '(\\d+)', 1), '') AS BIGINT), -1) END AS rank FROM directory")
def i53(spark, sf):
    return view(spark, sf, "directory").select("id", S.parse_size(c("size")).alias("parsed"), S.size_rank(c("size")).alias("rank"))


@query("I60_nested_fields", "SELECT event_id, coalesce(CAST(props::JSON->>'k' AS INTEGER), -1) AS k, coalesce(nullif(event_type, ''), 'none') AS kind FROM events")
def i60(spark, sf):
    p = F.from_json("props", "struct<k: int>")
    return read(spark, sf, "events").select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), F.coalesce(F.nullif("event_type", F.lit("")), F.lit("none")).alias("kind"))


@query("I61_I62_phases", """WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN ['PHASE2'] WHEN 1 THEN ['PHASE1', 'PHASE2'] WHEN 2 THEN ['NA'] WHEN 3 THEN ['EARLY_PHASE1'] WHEN 4 THEN NULL ELSE ['Phase 3'] END AS ps FROM part),
q AS (SELECT id, CASE id % 6 WHEN 0 THEN 'Phase 2' WHEN 1 THEN 'Phase 1/2' WHEN 2 THEN 'NA' WHEN 3 THEN 'EARLY_PHASE1' WHEN 4 THEN 'N/A' ELSE 'Phase 3' END AS label, CASE id % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 5 THEN 3 END AS number FROM p)
SELECT id, label, number, id % 6 = 1 AS combined, CASE number WHEN 2 THEN 'Phase 1' WHEN 3 THEN 'Phase 2' ELSE 'Pre-Clinical' END AS previous FROM q""")
def i61(spark, sf):
    ps = F.expr("CASE p_partkey % 6 WHEN 0 THEN array('PHASE2') WHEN 1 THEN array('PHASE1', 'PHASE2') WHEN 2 THEN array('NA') WHEN 3 THEN array('EARLY_PHASE1') WHEN 4 THEN NULL ELSE array('Phase 3') END")
    x = read(spark, sf, "part").select(c("p_partkey").alias("id"), S.phase(ps).alias("x"))
    return x.select("id", "x.*", S.previous_phase(c("x.number")).alias("previous"))


@query("I64_richness", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS rich FROM events")
def i64(spark, sf):
    detail = F.when(c("event_id") % 2 == 0, F.col("props")).otherwise(F.lit('{"a": "x", "b": "", "c": null, "d": 3}'))
    return read(spark, sf, "events").select("event_id", S.richness(detail).alias("rich"))


@query("I65_json_merge", """SELECT event_id, CAST(props::JSON->>'k' AS INTEGER) AS k, event_type AS source FROM events""")
def i65(spark, sf):
    old, new = F.from_json("props", "map<string,string>"), F.create_map(F.lit("source"), c("event_type"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    merged = F.map_concat(kept, new)
    return read(spark, sf, "events").select("event_id", merged["k"].cast("int").alias("k"), merged["source"].alias("source"))


@query("I67_blank_to_null_array", "SELECT o_orderkey, nullif(array_to_string(list_filter([trim(' ' || o_orderstatus), '', trim(CASE WHEN o_orderkey % 2 = 0 THEN ' x ' ELSE ' ' END)], lambda v: v <> ''), ','), '') AS engagement FROM orders")
def i67(spark, sf):
    a = F.array(F.concat(F.lit(" "), c("o_orderstatus")), F.lit(""), F.when(c("o_orderkey") % 2 == 0, " x ").otherwise(" "))
    kept = F.filter(F.transform(a, lambda v: F.trim(v)), lambda v: v != "")
    return read(spark, sf, "orders").select("o_orderkey", F.when(F.size(kept) > 0, F.array_join(kept, ",")).alias("engagement"))


@query("I68_first_source_wins", cte("directory") + "SELECT id, coalesce(domain, size, industry) AS v, coalesce(size, industry) AS w FROM directory")
def i68(spark, sf):
    return view(spark, sf, "directory").select("id", F.coalesce("domain", "size", "industry").alias("v"), F.coalesce("size", "industry").alias("w"))
