"""Dates, always relative to an as-of date that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.rules import MONTHS
from tidewater.functions.text import squeeze


def week_cutoff(now: Column) -> Column:
    """Seven days before the last midnight at UTC-5."""
    return F.date_trunc("day", now - F.expr("INTERVAL 5 HOURS")) + F.expr("INTERVAL 5 HOURS") - F.expr("INTERVAL 7 DAYS")


def named_date(c: Column) -> Column:
    """"April 20, 2026" anywhere in a text; null if there is none."""
    p = r"([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})"
    t = squeeze(c)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(t, p, 1), 1, 3)))
    text = F.concat_ws("-", F.regexp_extract(t, p, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, p, 2), 2, "0"))
    return F.when(month > 0, F.try_to_date(text, "yyyy-MM-dd"))


def relative_date(c: Column, as_of: Column) -> Column:
    """"3 days ago", "last week": the whole text; a month has 30 days."""
    t = F.lower(F.trim(c))
    n = F.regexp_extract(t, r"^(\d+)", 1).try_cast("int")
    days = (
        F.when(t.rlike(r"^\d+\s+(minutes?|hours?)\s+ago\z"), 0).when(t == "yesterday", 1).when(t.rlike(r"^\d+\s+days?\s+ago\z"), n).when(t == "last week", 7)
        .when(t.rlike(r"^\d+\s+weeks?\s+ago\z"), n * 7).when(t == "last month", 30).when(t.rlike(r"^\d+\s+months?\s+ago\z"), n * 30)
    )
    return F.date_sub(as_of, days)


def days_posted(c: Column) -> Column:
    """Age in days anywhere in a text; unknown is 0."""
    t = F.lower(c)
    n = lambda unit, k: F.regexp_extract(t, rf"(\d+)\s+{unit}", 1).try_cast("int") * k
    return F.coalesce(n("day", 1), n("week", 7), n("month", 30), F.lit(0))


def age_days(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)).cast("long")


def days_between(a: Column, b: Column) -> Column:
    """abs(floor(a - b)): half a day before is 1, half a day after 0; 999 if unknown."""
    return F.coalesce(F.abs(F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)), F.lit(999)).cast("long")


def url_date(c: Column) -> Column:
    p = r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|\z)"
    return F.try_to_date(F.concat_ws("-", F.regexp_extract(c, p, 1), F.lpad(F.regexp_extract(c, p, 2), 2, "0"), F.lpad(F.regexp_extract(c, p, 3), 2, "0")), "yyyy-MM-dd")


def iso_date(c: Column) -> Column:
    return F.try_to_date(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def weeks(start: Column, end: Column) -> Column:
    """Array of (start, end): spans of at most seven days that cover the range."""
    return F.transform(F.sequence(start, end, F.expr("INTERVAL 7 DAYS")), lambda d: F.struct(d.alias("start"), F.least(F.date_add(d, 6), end).alias("end")))


def days_from(as_of: Column, days: int) -> Column:
    """So many days after (before, if negative) an as-of date."""
    return F.date_add(as_of, days)


def months_from(as_of: Column, months: int) -> Column:
    """So many months on; a day that the month lacks runs over into the next one."""
    first = F.add_months(F.trunc(as_of, "month"), months)
    return F.date_add(first, F.dayofmonth(as_of) - 1)


def slashed(day: Column) -> Column:
    return F.date_format(day, "MM/dd/yyyy")
