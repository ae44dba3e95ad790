"""Scans: fetched records to stored rows, each as one plan: what is new, whom it
belongs to, and what was learnt about names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.scores import parse_size
from tidewater.operators import resolve
from tidewater.operators import tables as O
from tidewater.operators.lookup import lookup
from tidewater.operators.state import age_queue
from tidewater.sources import sinks

c = F.col


def sizes(directory: DataFrame) -> DataFrame:
    """(matched_name, company_size): each directory name's largest size."""
    best = directory.filter("name <> ''").groupBy(c("name").alias("matched_name")).agg(F.min(F.struct(-parse_size(c("size")), "size")).alias("b"))
    return best.select("matched_name", c("b.size").alias("company_size"))


def with_size(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows with the company_size of their matched_name, which comes first. A lookup: by
    its file alone a directory of short rows looks small, and its names were broadcast
    whole; rows without a match don't meet in one task."""
    out = lookup(rows, sizes(directory), ["matched_name"])
    return out.select("matched_name", *[x for x in out.columns if x != "matched_name"])


def trial_scan(trials: DataFrame, stored: DataFrame, alternates: DataFrame, directory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trials, alternates to add). trials: nct_id, sponsor, emails and more; they get
    matched_name, company_size and action: updated if `stored` has the nct_id, else
    inserted.

    A sponsor whose name (in any case) has no alternate yet is matched to the
    directory, by the addresses of its first trial (in order of nct_id) with one that
    names a company; what is found, or no_match, is an alternate from then on."""
    key = F.lower(F.trim("sponsor"))
    known = alternates.groupBy(F.lower(F.trim("alternate_name")).alias("k")).agg(F.min(F.struct("directory_name", "matched_via")).alias("known"))
    each = trials.filter("trim(sponsor) <> ''").withColumn("k", key).withColumn("no_domain", T.email_domain(c("emails")).isNull())
    new = each.groupBy("k").agg(F.min(F.struct("no_domain", "nct_id", "sponsor", "emails")).alias("b")).join(known.select("k"), "k", "left_anti").select(c("b.sponsor").alias("sponsor"), c("b.emails").alias("emails"))
    matched = resolve.match_sponsor(new, directory)
    learnt = matched.select(c("matched_name").alias("directory_name"), c("sponsor").alias("alternate_name"), "matched_via")
    names = known.select("k", "known.directory_name", "known.matched_via").union(learnt.select(F.lower(F.trim("alternate_name")), "directory_name", "matched_via"))
    names = names.filter("matched_via <> 'no_match'").select("k", c("directory_name").alias("matched_name"))
    out = with_size(trials.withColumn("k", key).join(names, "k", "left").drop("k"), directory)
    there = stored.select("nct_id").distinct().withColumn("there", F.lit(True))
    return out.join(there, "nct_id", "left").withColumn("action", F.when(c("there"), "updated").otherwise("inserted")).drop("there"), learnt


def grant_scan(grants: DataFrame, stored: DataFrame, directory: DataFrame) -> DataFrame:
    """Grants (appl_id, org_name and more) that are not stored yet, each appl_id
    once, with matched_name, matched_via and company_size, null if none."""
    new = O.insert_new(stored, grants.filter("appl_id <> ''"), ["appl_id"], ["org_name"])
    return with_size(resolve.match_company(new, directory, "org_name"), directory)


def news_scan(cards: DataFrame, stored: DataFrame, directory: DataFrame, alternates: DataFrame, since: Column | None = None) -> DataFrame:
    """Cards (title, article_url, article_date) that are not stored yet, each url
    once (the least title), with matched_names, null if none. Where `since` is given,
    dated cards before it are left out: pages end with the first such card."""
    some = cards if since is None else cards.filter(c("article_date").isNull() | (c("article_date") >= since))
    new = O.insert_new(stored, some.filter("article_url <> ''"), ["article_url"], ["title"])
    names = resolve.match_titles(new, directory, alternates, key="article_url", title="title")
    return new.join(names, "article_url", "left")


def write_scan(rows: DataFrame, path: str) -> dict[str, int]:
    """Stores what a scan keeps (rows with matched_name); returns new, matched and
    unmatched as the write itself has counted them."""
    name = c("matched_name")
    kept, observed = sinks.counted(rows, new=F.count(F.lit(1)), matched=F.count(name), unmatched=F.count_if(name.isNull()))
    kept.write.mode("append").parquet(path)
    return observed.get


def counted_fetch(fetched: DataFrame) -> tuple[DataFrame, Observation]:
    """fetched, and how many rows of it the scan's write has read, as fetched."""
    return sinks.counted(fetched, fetched=F.count(F.lit(1)))


def orchestrate(signals: DataFrame, found: dict[str, DataFrame], as_of: str) -> tuple[DataFrame, DataFrame]:
    """(queue, counts) after the agents' signals (found, by agent) have come to the
    active ones: the queue aged and scored anew; counts: (agent, n), with the rows
    carried forward and the active ones under names of their own. `found` has the
    columns of signals, as age_queue takes them."""
    every = signals
    for rows in found.values():
        every = every.unionByName(rows, allowMissingColumns=True)
    queue = age_queue(every, as_of)
    counts = {k: v.agg(F.count(F.lit(1)).alias("n")) for k, v in found.items()}
    counts["carried_forward"] = queue.agg(F.count_if("is_carried_forward").alias("n"))
    counts["active"] = queue.agg(F.count(F.lit(1)).alias("n"))
    return queue, O.union_tagged(counts, "agent").select("agent", "n")


def enrich(signals: DataFrame, pages: DataFrame) -> DataFrame:
    """Deal signals (id, company_name, source_url, detail: map) whose detail lacks a
    deal's value or parties, from the pages' texts (source_url, text), by the rules
    of the second pass: keys that the detail has stay."""
    lacking = F.coalesce(F.try_element_at("detail", F.lit("deal_value")), F.try_element_at("detail", F.lit("acquired_name")), F.lit("")) == ""
    texts = pages.groupBy("source_url").agg(F.min("text").alias("text"))
    rows = T.with_deal(signals.filter(lacking).join(texts, "source_url"), "text", "company_name", backfill=True)
    keys = ("transaction_type", "acquirer_name", "acquired_name", "deal_value")
    new = F.map_from_entries(F.filter(F.array(*[F.when(F.coalesce(c(k), F.lit("")) != "", F.struct(F.lit(k).alias("key"), c(k).alias("value"))) for k in keys]), lambda e: e.isNotNull()))
    old = F.map_filter(F.coalesce("detail", F.expr("CAST(map() AS map<string, string>)")), lambda _, v: F.coalesce(v, F.lit("")) != "")
    new = F.map_filter(new, lambda k, _: ~F.array_contains(F.map_keys(old), k))
    return rows.select("id", F.map_concat(old, new).alias("detail"))
