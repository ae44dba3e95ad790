"""The size check: from company pages to exclusions, reinstatements and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.operators import resolve
from tidewater.operators.lookup import lookup
from tidewater.operators.state import exclusion_update

c = F.col


def _key(x: str = "name"):
    return F.lower(F.trim(x))


def observed_sizes(to_check: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, members) that the companies' pages (name, html) tell. A page that is
    blocked or too short, names another company or no size tells nothing."""
    told = pages.filter(F.length("html") >= R.PAGE_CHARS)
    for word in R.BLOCKED_PAGES:
        told = told.filter(~F.contains("html", F.lit(word)))
    told = told.groupBy(_key().alias("__k")).agg(F.max("html").alias("html"))
    seen = lookup(to_check.select("name").withColumn("__k", _key()), told, ["__k"])
    seen = seen.filter(c("html").isNotNull()).withColumn("page", T.page_company(c("html"))).filter(T.same_company(c("name"), c("page")))
    return seen.select("name", T.employee_count(c("html")).alias("members")).filter("members IS NOT NULL")


def size_check(signals: DataFrame, companies: DataFrame, excluded: DataFrame, pages: DataFrame, clients: DataFrame, least: int = 10_001) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(excluded, signals, changes) after one check.

    signals: id, company_id, signal_type; companies: id, name; excluded: name, members;
    pages: name, html; clients as resolve.match_clients takes them. Checked are the
    companies of signals of the checked kinds, and all that are excluded. From `least`
    members on a company is excluded, unless it is a past client's, which stays as it
    was; below it an excluded one is reinstated; all others stay. Signals of newly
    excluded companies go. changes: (name, change), excluded or reinstated."""
    used = signals.filter(c("signal_type").isin(*R.SIZE_CHECKED)).select(c("company_id").alias("id")).distinct()
    names = companies.join(used, "id", "left_semi").select("name").union(excluded.select("name"))
    # one spelling for each company: that of the companies table, else the list's
    names = names.filter("trim(name) <> ''").groupBy(_key().alias("k")).agg(F.min("name").alias("name"))
    seen = observed_sizes(names, pages)
    large = seen.filter(c("members") >= least).select("name")
    clients_of = resolve.match_clients(large, clients).select(_key().alias("k"))
    seen = seen.withColumn("k", _key()).join(clients_of.distinct(), "k", "left_anti").select("name", "members", "k")
    listed = excluded.select(_key().alias("k")).distinct()
    small = seen.filter(c("members") < least).join(listed, "k", "left_semi")
    new = seen.filter(c("members") >= least).join(listed, "k", "left_anti")
    # small companies that are not on the list are no news for it
    news = seen.filter(c("members") >= least).unionByName(small).select("name", "members")
    after = exclusion_update(excluded, news, least).filter("excluded").select("name", "members")
    gone = companies.withColumn("k", _key()).join(new.select("k"), "k", "left_semi").select(c("id").alias("company_id")).distinct()
    changes = new.select("name", F.lit("excluded").alias("change")).union(small.select("name", F.lit("reinstated")))
    return after, signals.join(gone, "company_id", "left_anti").select(*signals.columns), changes
