"""Snapshots that change: queue ageing, exclusion, contact updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scores as S
from tidewater.functions.text import strip


def age_queue(signals: DataFrame, as_of: str) -> DataFrame:
    """Active signals with is_carried_forward, days_in_queue and a new score.

    signals: status, first_detected_at, strength, base, warmth, actionability,
    boost, nested_boost. A missing first day counts as today."""
    today = F.lit(as_of).cast("timestamp")
    at = F.coalesce("first_detected_at", today)
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp(today) - F.unix_timestamp(at)) / 86400)).cast("int")
    c = F.col
    return (
        signals.filter(c("status").isin("new", "carried_forward"))
        .withColumn("is_carried_forward", (c("status") == "new") & (at < today)).withColumn("days_in_queue", days)
        .withColumn("priority_score", S.queue_score(c("days_in_queue"), c("strength"), c("base"), c("warmth"), c("actionability"), c("boost"), c("nested_boost")).cast("double"))
    )


def exclusion_update(excluded: DataFrame, observed: DataFrame, least: int = 10_001) -> DataFrame:
    """(name, members, excluded): observations (name, members) over the old list:
    excluded from `least` members on, reinstated below it, unobserved ones as they
    were."""
    o = observed.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.max(F.struct("members", "name")).alias("o"))
    e = excluded.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.max(F.struct("members", "name")).alias("e"))
    both = e.join(o, "k", "full_outer")
    members = F.coalesce("o.members", "e.members")
    return both.select(F.coalesce("e.name", "o.name").alias("name"), members.alias("members"), F.coalesce(F.col("o.members") >= least, F.lit(True)).alias("excluded"))


def normal(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def add_history(history: Column, role: Column, company: Column) -> Column:
    """history with {role, company}, unless one of them is blank or it is there."""
    h = F.coalesce(history, F.expr("CAST(array() AS array<struct<role: string, company: string>>)"))
    there = F.exists(h, lambda e: (normal(e["role"]) == normal(role)) & (normal(e["company"]) == normal(company)))
    return F.when((normal(role) == "") | (normal(company) == "") | there, h).otherwise(F.array_append(h, F.struct(role.alias("role"), company.alias("company"))))


def update_contacts(contacts: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """contacts after one update for each linkedin_url at most.

    contacts: linkedin_url, original_title, original_company, current_title,
    current_company, current_location, job_history, last_change_type,
    last_enrichment_date; incoming: linkedin_url, title, company, location."""
    c, i = contacts.alias("c"), incoming.withColumn("__in", F.lit(True)).alias("i")
    col = lambda x: F.col(f"c.{x}")
    role = normal(F.col("i.title")) != normal(col("current_title"))
    company = normal(F.col("i.company")) != normal(col("current_company"))
    place = normal(F.col("i.location")) != normal(col("current_location"))
    differ = (normal(col("original_title")) != normal(col("current_title"))) | (normal(col("original_company")) != normal(col("current_company")))
    hit, moved = F.col("i.__in").isNotNull(), role | company
    shift = hit & (moved | differ)
    pick = lambda when, new, old: F.when(when, new).otherwise(old)
    change = F.when(role & company, "both_changed").when(role, "role_changed").when(company, "company_changed")
    return c.join(i, normal(F.col("c.linkedin_url")) == normal(F.col("i.linkedin_url")), "left").select(
        col("linkedin_url"),
        pick(shift, col("current_title"), col("original_title")).alias("original_title"),
        pick(shift, col("current_company"), col("original_company")).alias("original_company"),
        pick(hit & moved, F.col("i.title"), col("current_title")).alias("current_title"),
        pick(hit & moved, F.col("i.company"), col("current_company")).alias("current_company"),
        pick(hit & place, F.col("i.location"), col("current_location")).alias("current_location"),
        pick(shift, add_history(col("job_history"), col("original_title"), col("original_company")), col("job_history")).alias("job_history"),
        pick(hit, change, col("last_change_type")).alias("last_change_type"),
        pick(hit, F.lit(as_of).cast("date"), col("last_enrichment_date")).alias("last_enrichment_date"),
    )


_STATE = ("original_title", "original_company", "current_title", "current_company", "current_location", "job_history", "last_change_type", "last_enrichment_date")


def update_contacts_in_turn(contacts: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """contacts after all updates (linkedin_url, title, company, location,
    received_at) of each, one after another in order of arrival: a fold over the
    contact's updates, as update_contacts applies one."""
    turns = incoming.groupBy(normal(F.col("linkedin_url")).alias("__k")).agg(F.array_sort(F.collect_list(F.struct("received_at", "title", "company", "location"))).alias("__turns"))
    rows = contacts.withColumn("__k", normal(F.col("linkedin_url"))).join(turns, "__k", "left")
    history = "array<struct<role: string, company: string>>"
    kinds = {"job_history": history, "last_enrichment_date": "date"}
    start = F.struct(*[F.col(x).cast(kinds.get(x, "string")).alias(x) for x in _STATE])

    def turn(s, i):
        role, company = normal(i["title"]) != normal(s["current_title"]), normal(i["company"]) != normal(s["current_company"])
        place, moved = normal(i["location"]) != normal(s["current_location"]), role | company
        shift = moved | (normal(s["original_title"]) != normal(s["current_title"])) | (normal(s["original_company"]) != normal(s["current_company"]))
        pick = lambda when, new, old: F.when(when, new).otherwise(s[old])
        return F.struct(
            pick(shift, s["current_title"], "original_title").alias("original_title"), pick(shift, s["current_company"], "original_company").alias("original_company"),
            pick(moved, i["title"], "current_title").alias("current_title"), pick(moved, i["company"], "current_company").alias("current_company"),
            pick(place, i["location"], "current_location").alias("current_location"), pick(shift, add_history(s["job_history"], s["original_title"], s["original_company"]), "job_history").alias("job_history"),
            F.when(role & company, "both_changed").when(role, "role_changed").when(company, "company_changed").alias("last_change_type"), F.lit(as_of).cast("date").alias("last_enrichment_date"),
        )

    after = F.aggregate(F.coalesce("__turns", F.expr("CAST(array() AS array<struct<received_at: timestamp, title: string, company: string, location: string>>)")), start, turn)
    return rows.withColumn("__s", after).select("linkedin_url", *[F.col(f"__s.{x}").alias(x) for x in _STATE], *[x for x in contacts.columns if x not in ("linkedin_url", *_STATE)])


def move_rows(source: DataFrame, target: DataFrame, ids: DataFrame, rename: dict[str, str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(source, target) after the rows of these ids have moved; rows whose key the
    target has stay away from it."""
    moving = source.join(ids, key, "left_semi").withColumnsRenamed(rename)
    added = moving.join(target.select(key), key, "left_anti")
    return source.join(ids, key, "left_anti"), target.unionByName(added, allowMissingColumns=True)
