"""URL filter: explicit rules, and Empirical-Bayes host reputation for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import join_small, packed, stored, table, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict): the host and all its subdomains, paths that begin so.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Public suffixes of two labels where no table of suffixes is given; of any other
#: host the last label is the suffix.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")

#: A host is blocked if the lower bound of its bad rate is over this many times
#: the bad rate of all labelled pages; the bound is the posterior's 10% quantile, so
#: many standard deviations of its log-odds below their mean.
LIFT, DEVIATIONS = 1.2, 1.2816
#: Range of the prior's strength, in pages.
STRENGTH = (2.0, 200.0)

OUT = ("host", "path", "rule", "verdict", "domain", "suffix", "n_labelled", "bad_rate", "bound")


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _last_labels(host: Column, n: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -n)


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (host, unique, and other columns) with domain (a label and the suffix)
    and suffix: the longest of the table `suffixes` (suffix) that the host ends
    with, or by TWO_LABEL_SUFFIXES; a host that ends with none: its last label. An
    IP address is its own domain and suffix."""
    b = F.col("__bare")
    rows = hosts.withColumn("__bare", bare(F.col("host")))
    two = F.substring_index(b, ".", -2)
    n = F.when(two.isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    if suffixes is not None:
        known = suffixes.select(F.lower(F.trim("suffix")).alias("__tail")).filter("__tail <> ''").distinct()
        labels = F.split(b, "[.]")
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("n"), _last_labels(b, i).alias("__tail")))
        hit = join_small(rows.select("host", F.inline(tails)), known, ["__tail"], "inner").groupBy("host").agg(F.max("n").alias("__n"))
        rows = rows.join(hit, "host", "left")
        n = F.coalesce("__n", F.lit(1))
    ip = b.rlike(r"^[0-9]+([.][0-9]+){3}$|^\[")
    rows = rows.withColumn("__n", n).withColumn("suffix", F.when(ip, b).otherwise(_last_labels(b, F.col("__n"))))
    return rows.withColumn("domain", F.when(ip, b).otherwise(_last_labels(b, F.col("__n") + 1))).drop("__n", "__bare")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    fits = rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        on_host = (host == h) | host.endswith("." + h)
        fits = on_host & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _strength() -> Column:
    """Of groups with n pages, x of them bad: the strength of their beta-binomial
    prior by moments, from how far the groups' rates lie apart beyond what their
    sizes explain. An aggregate; groups without pages count for nothing."""
    total = lambda c: F.sum(c).cast("double")
    n, x, k = total("n"), total("x"), F.count_if(F.col("n") > 0)
    p = x / F.greatest(n, F.lit(1.0))
    excess = F.sum(F.col("x") * F.col("x") / F.greatest(F.col("n"), F.lit(1))) - x * p - (k - 1) * (p * (1 - p))
    scale = (n - F.sum(F.col("n") * F.col("n")) / F.greatest(n, F.lit(1.0))) * (p * (1 - p))
    rho = F.when(scale > 0, excess / scale).otherwise(0.0)
    return F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(STRENGTH[1])


def _digamma(a: Column) -> Column:
    y = a + 3
    return F.ln(y) - 1 / (2 * y) - 1 / (12 * y * y) - 1 / a - 1 / (a + 1) - 1 / (a + 2)


def _trigamma(a: Column) -> Column:
    y = a + 3
    return 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) + 1 / (a * a) + 1 / ((a + 1) * (a + 1)) + 1 / ((a + 2) * (a + 2))


def lower_bound(a: Column, b: Column, deviations: float = DEVIATIONS) -> Column:
    """A lower quantile of the beta law of a and b: that of the normal law with the
    mean and variance of its log-odds. 0 or 1 where the law has one value only."""
    odds = _digamma(a) - _digamma(b) - deviations * F.sqrt(_trigamma(a) + _trigamma(b))
    return F.when(a <= 0, 0.0).when(b <= 0, 1.0).otherwise(1 / (1 + F.exp(-odds)))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts: (host); outcomes: (host, bad 0 or 1), one row for each labelled
    page. Returns host, domain, suffix, n_labelled, bad_rate (posterior mean),
    bound (its lower bound) for each distinct host. Outcomes of other hosts count too:
    for the rates of their domains and suffixes.

    The rate of all pages is the prior of each suffix. A domain's prior is the
    posterior mean of its suffix without the domain's own pages, a host's that of
    its domain without its own, so that no page counts twice; its strength is fitted
    to the level, and no more than the pages and prior that it comes from. Hosts
    without labelled pages get their prior. Without any outcomes the rate and the
    bound are 0."""
    bad = outcomes.filter("bad IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("x"))
    asked = hosts.select("host", F.lit(True).alias("__asked")).union(bad.select("host", F.lit(False))).groupBy("host").agg(F.max("__asked").alias("__asked"))
    every = asked.join(bad, "host", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("x", F.coalesce("x", F.lit(0).cast("long")))
    every = stored(with_domains(every, suffixes).withColumn("__one", F.lit(1)), "rates")
    sums = (F.sum("n").alias("n"), F.sum("x").alias("x"))
    top = every.groupBy("__one").agg(*sums).select("__one", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(F.lit(0.0)).alias("__p"))
    wanted = every.filter("__asked").select("host")
    parents, up, parent = ["__one"], every, top
    for key in ("suffix", "domain", "host"):
        groups = every.groupBy(*parents, key).agg(*sums)
        prior = groups.groupBy(*parents).agg(_strength().alias("__m")).join(parent, parents)
        # one suffix may have a third of the domains, one domain a third of the hosts
        g = join_small(groups, prior, parents, "inner")
        if key == "suffix":
            m, p = F.col("__m"), F.col("__p")
        else:
            # what the parent has besides this group
            others = F.col("__a") + F.col("__b") + F.col("__n") - F.col("n")
            m, p = F.least(F.col("__m"), others), (F.col("__a") + F.col("__x") - F.col("x")) / others
        up = g.select(*parents, key, "n", "x", (m * p).alias("__a"), (m * (1 - p)).alias("__b"))
        parents = parents + [key]
        parent = up.select(*parents, "__a", "__b", F.col("n").alias("__n"), F.col("x").alias("__x"))
    a, b = F.col("__a") + F.col("x"), F.col("__b") + F.col("n") - F.col("x")
    up = up.withColumn("__p", a / (a + b)).withColumn("__bound", lower_bound(a, b))
    up = up.join(wanted, "host", "left_semi")
    return up.select("host", "domain", "suffix", F.col("n").alias("n_labelled"), F.col("__p").alias("bad_rate"), F.col("__bound").alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, *, url: str = "url", rules=RULES, lift: float = LIFT, suffixes: DataFrame | None = None, least_labelled: int = 0) -> DataFrame:
    """All rows of pages with host, path, rule, verdict, domain, suffix,
    n_labelled, bad_rate and bound; input columns of these names are replaced.

    outcomes: (host, bad), a row for each labelled page; suffixes: (suffix), a table
    of public suffixes, if there is one. A url that a rule fits
    gets the longest rule's verdict; any other is blocked if the lower bound of
    its host's bad rate is over `lift` times the rate of all labelled pages. A host
    without labelled pages is judged by what its domain and suffix leave it, unless
    `least_labelled` asks for pages of its own.
    Null url or none with "://": host and path empty, and a host like any other.
    Repeated rows are judged alike. Very long urls are taken whole. No outcomes: no
    host is blocked. No rows: no rows.
    """
    rows = packed(pages, OUT, host=host_of(F.col(url)), path=path_of(F.col(url)))
    reputation = stored(host_reputation(rows.select("host"), outcomes, suffixes), "hosts")
    rate = outcomes.filter("bad IS NOT NULL").agg(F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0))).first()[0]
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when((F.col("bound") > F.lit(rate * lift)) & (F.col("n_labelled") >= least_labelled), "block").otherwise("allow")
    out = join_small(rows, reputation, ["host"]).withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, judged))
    return unpacked(out, pages, OUT)


#: The letters of a page's article: title, tags, white space and entities go.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))


def article_digest(html: Column) -> Column:
    x = F.regexp_extract(html, r"(?s)<article><h1>[^<]*</h1>(.*?)</article>", 1)
    x = F.regexp_replace(x, "<[^>]*>", "")
    for a, b in _ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.md5(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "").cast("binary"))


def text_digest(text: Column) -> Column:
    return F.md5(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary"))


def labelled_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) for each page whose article is the text of a labelled
    document: bad if one such document is toxic or of low quality."""
    bad = labels.groupBy("doc_id").agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    texts = docs.select("doc_id", text_digest(F.col("text")).alias("__d")).join(bad, "doc_id").groupBy("__d").agg(F.max("bad").alias("bad"))
    return pages.select(host_of(F.col("url")).alias("host"), article_digest(F.col("html")).alias("__d")).transform(lambda p: join_small(p, texts, ["__d"], "inner")).select("host", "bad")


def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    outcomes = stored(labelled_outcomes(pages, docs, labels), "outcomes")
    return filter_urls(pages.select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict", "n_labelled")


def _sql_rule(value: int) -> str:
    """CASE over the rules, longest first: the rule (0) or its verdict (1)."""
    whens = []
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        whens.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'")
    return "CASE " + " ".join(whens) + " END"


def _sql_level(key: str, parents: list[str], parent: str) -> str:
    by = ", ".join(parents)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in parents)
    low, high = STRENGTH
    others = "(pa + pb + pn - n)"
    mean = f"m_{key} AS (SELECT *, fit AS m FROM f_{key})" if key == "suffix" else f"m_{key} AS (SELECT *, least(fit, {others}) AS m, (pa + px - x) / {others} AS p FROM f_{key})"
    return f"""
g_{key} AS (SELECT {by}, {key}, sum(n)::BIGINT AS n, sum(x)::BIGINT AS x FROM every GROUP BY ALL),
s_{key} AS (SELECT {by}, sum(n)::DOUBLE AS n, sum(x)::DOUBLE AS x, count(*) AS k, sum(n * n)::DOUBLE AS n2, sum(x * x / n::DOUBLE) AS x2n FROM g_{key} WHERE n > 0 GROUP BY ALL),
r_{key} AS (SELECT *, CASE WHEN (n - n2 / n) * (x / n * (1 - x / n)) > 0 THEN (x2n - x * (x / n) - (k - 1) * (x / n * (1 - x / n))) / ((n - n2 / n) * (x / n * (1 - x / n))) ELSE 0.0 END AS rho FROM s_{key}),
f_{key} AS (SELECT g.*, p.* EXCLUDE ({by}), coalesce(CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, {low}), {high}) ELSE {high} END, {high})::DOUBLE AS fit
  FROM g_{key} g JOIN {parent} p ON {on("g", "p")} LEFT JOIN r_{key} r ON {on("g", "r")}),
{mean},
p_{key} AS (SELECT {by}, {key}, n AS pn, x AS px, m * p AS pa, m * (1 - p) AS pb FROM m_{key})"""


def _sql_entities(x: str) -> str:
    for a, b in _ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


_SPACE = r"'[\x20\x09-\x0D]+'"
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_LABELS = "string_split(bare, '.')"
_IP = r"regexp_matches(bare, '^[0-9]+([.][0-9]+){3}$|^\[')"


def _sql_gamma(a: str, tri: bool) -> str:
    y = f"({a} + 3)"
    if tri:
        return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y}) + 1 / ({a} * {a}) + 1 / (({a} + 1) * ({a} + 1)) + 1 / (({a} + 2) * ({a} + 2)))"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) - 1 / {a} - 1 / ({a} + 1) - 1 / ({a} + 2))"


_ODDS = f"{_sql_gamma('(r.pa + r.px)', False)} - {_sql_gamma('(r.pb + r.pn - r.px)', False)} - {DEVIATIONS} * sqrt({_sql_gamma('(r.pa + r.px)', True)} + {_sql_gamma('(r.pb + r.pn - r.px)', True)})"
_BOUND = f"CASE WHEN r.pa + r.px <= 0 THEN 0 WHEN r.pb + r.pn - r.px <= 0 THEN 1 ELSE 1 / (1 + exp(-({_ODDS}))) END"
OP2_SQL = (
    rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
bad AS (SELECT doc_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad FROM labels GROUP BY doc_id),
t AS (SELECT md5(regexp_replace(text, {_SPACE}, '', 'g')) AS d, max(bad) AS bad FROM documents JOIN bad USING (doc_id) GROUP BY 1),
a AS (SELECT host, md5(regexp_replace({_sql_entities("regexp_replace(regexp_extract(html, '(?s)<article><h1>[^<]*</h1>(.*?)</article>', 1), '<[^>]*>', '', 'g')")}, {_SPACE}, '', 'g')) AS d FROM h),
o AS (SELECT host, bad FROM a JOIN t USING (d)),
c AS (SELECT host, count(*) AS n, sum(bad)::BIGINT AS x FROM o GROUP BY host),
e AS (SELECT DISTINCT h.host, coalesce(n, 0) AS n, coalesce(x, 0) AS x, regexp_replace(regexp_replace(h.host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h LEFT JOIN c USING (host)),
e2 AS (SELECT *, array_to_string(list_reverse(list_reverse({_LABELS})[1:2]), '.') AS two FROM e),
every AS (SELECT host, n, x, 1 AS one, CASE WHEN {_IP} THEN bare WHEN two IN ({_TWO}) THEN two ELSE {_LABELS}[-1] END AS suffix,
  CASE WHEN {_IP} THEN bare WHEN two IN ({_TWO}) THEN array_to_string(list_reverse(list_reverse({_LABELS})[1:3]), '.') ELSE two END AS domain FROM e2),
p_one AS (SELECT one, CASE WHEN sum(n) > 0 THEN sum(x) / sum(n)::DOUBLE ELSE 0.0 END AS p FROM every GROUP BY one),"""
    + ",".join((_sql_level("suffix", ["one"], "p_one"), _sql_level("domain", ["one", "suffix"], "p_suffix"), _sql_level("host", ["one", "suffix", "domain"], "p_domain")))
    + f"""
SELECT page_id, h.host, path, {_sql_rule(0)} AS rule,
  coalesce({_sql_rule(1)}, CASE WHEN {_BOUND} > (SELECT coalesce(avg(bad), 0) FROM o) * {LIFT} THEN 'block' ELSE 'allow' END) AS verdict, r.pn AS n_labelled
FROM h JOIN p_host r ON r.host = h.host
""".replace("host = '", "h.host = '").replace("ends_with(host", "ends_with(h.host").replace("AND h.host = r.host", "AND host = r.host")
)
