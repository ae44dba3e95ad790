"""Scores and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """Null for 0, as scores count 0 as missing."""
    return F.nullif(c, F.lit(0))


def recency(days: Column) -> Column:
    return F.when(days <= 7, F.greatest(25 - days * 3, F.lit(10))).otherwise(F.least(F.lit(10) + F.floor((days - 7) / 3), F.lit(25)))


def queue_score(days: Column, strength: Column, base: Column, warmth: Column, actionability: Column, boost: Column, nested_boost: Column) -> Column:
    zero = F.lit(0)
    total = F.coalesce(truthy(strength), truthy(base), F.lit(15)) + recency(F.coalesce(days, zero)) + F.coalesce(warmth, zero) + F.coalesce(actionability, zero)
    return F.least(total + F.coalesce(truthy(boost), truthy(nested_boost), zero), F.lit(100))


def client_boost(rank: Column) -> Column:
    r = F.coalesce(rank, F.lit(0))
    linear = F.floor(15 - (r - 1) / 17.0 * 5 + 0.5)
    return F.when(rank.isNull(), 15).when(rank <= 18, linear).otherwise(8).cast("long")


def age_score(days: Column) -> Column:
    return F.when(days >= 60, 18).when(days >= 30, 17).otherwise(15)


def parse_size(c: Column) -> Column:
    """Lower bound of a size label: "10,001+ employees" is 10001; 0 if none."""
    return F.coalesce(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("long"), F.lit(0)).cast("long")


def size_rank(c: Column) -> Column:
    digits = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("long")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", -1).when(F.contains(F.lower(c), F.lit("self-employed")), 1).otherwise(F.coalesce(digits, F.lit(-1))).cast("long")


def grant_amount(c: Column) -> Column:
    return F.concat(F.lit("$"), F.floor(c / 1000 + 0.5).cast("long").cast("string"), F.lit("K"))


def phase(phases: Column) -> Column:
    """(label, number, combined): the highest number of several phases."""
    norm = F.transform(phases, lambda p: F.regexp_replace(F.upper(p), r"\s", ""))
    number = lambda p: F.regexp_extract(p, r"^PHASE([1-4])\z", 1).try_cast("int")
    short = lambda p: F.regexp_replace(p, "^PHASE", "")
    one = F.when(F.try_element_at(norm, F.lit(1)).rlike("^PHASE"), F.concat(F.lit("Phase "), short(F.try_element_at(norm, F.lit(1))))).otherwise(F.try_element_at(norm, F.lit(1)))
    label = F.when(F.coalesce(F.size(phases), F.lit(0)) <= 0, "N/A").when(F.size(norm) == 1, one).otherwise(F.concat(F.lit("Phase "), F.array_join(F.transform(norm, short), "/")))
    return F.struct(label.alias("label"), F.array_max(F.transform(norm, number)).alias("number"), (F.coalesce(F.size(phases), F.lit(0)) > 1).alias("combined"))


def stored_phase(label: Column) -> Column:
    """A stored label in the form of phase()'s: PHASE2 -> Phase 2, PRE_CLINICAL ->
    Pre-Clinical, others as they are."""
    t = F.trim(label)
    return F.when(t.rlike(r"(?i)^PHASE\d+\z"), F.regexp_replace(t, "(?i)^PHASE", "Phase ")).when(t.rlike(r"(?i)^PRE[-_]CLINICAL\z"), "Pre-Clinical").otherwise(t)


def phase_of_label(label: Column) -> Column:
    """The number of a label's first phase."""
    return F.regexp_extract(label, r"Phase (\d+)", 1).try_cast("int")


def scan_phase(phases: Column) -> Column:
    """Phases one after another, each in words: Phase 1/Phase 2; null if there is none."""
    return F.nullif(F.array_join(F.transform(phases, lambda p: F.regexp_replace(p, "(?i)^PHASE", "Phase ")), "/"), F.lit(""))


def previous_phase(number: Column) -> Column:
    return F.when(number == 2, "Phase 1").when(number == 3, "Phase 2").when(number == 4, "Phase 3").otherwise("Pre-Clinical")


def richness(detail: Column) -> Column:
    """Top-level values of a JSON object that are neither null nor empty."""
    values = F.map_values(F.from_json(detail, "map<string,string>"))
    return F.coalesce(F.size(F.filter(values, lambda v: v.isNotNull() & (v != ""))), F.lit(0))
