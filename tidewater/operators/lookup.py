"""Joins to a table that is unique in its key, safe for hot and for missing keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of the table over which the rows of a key are dealt, and places over which
#: rows without a key are spread.
SALTS, PLACES = 8, 1 << 20


def _given(df: DataFrame, key: str) -> Column:
    here = F.col(key).isNotNull()
    return here & (F.col(key) != "") if df.schema[key].dataType.simpleString() == "string" else here


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once for a row: as they come of a generator,
    what tests them later stays behind it and doesn't repeat them at the scan."""
    own = df.withColumns({f"__of_{k}": v for k, v in columns.items()})
    return own.select(*df.columns, F.inline(F.array(F.struct(*[F.col(f"__of_{k}").alias(k) for k in columns]))))


def lookup(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """All rows of df with the columns of the row of `table`, unique in `on`, that has
    the same key; a null or empty key has none.

    Rows without a key are spread over places that the table doesn't have, so they
    don't meet in one task; rows of a common key are dealt over SALTS copies of the
    table's row. The copies come of a join, as Spark counts them then: an exploded table
    of millions of names looks as small as its file and was broadcast eight times over.
    What is small with its copies is broadcast, as Spark does."""
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    given = reduce(Column.__and__, [_given(df, k) for k in on])
    dealt = df.withColumn("__salt", F.when(given, F.pmod(row, F.lit(SALTS))).otherwise(-1 - F.pmod(row, F.lit(PLACES))).cast("int"))
    salts = df.sparkSession.range(0, SALTS, 1, 1).select(F.col("id").cast("int").alias("__salt"))
    copies = table.crossJoin(F.broadcast(salts))
    return dealt.join(copies, [*on, "__salt"], "left").drop("__salt")


def prefixes_in(df: DataFrame, text: str, others: DataFrame, other: str, group: tuple[Column, Column] | None = None) -> DataFrame:
    """df with __prefix: a row for each prefix of `text` as long as some `other` of the
    same group (by default: the same first character). A prefix then equals an other
    exactly, with no test behind the join; a text has as many rows as lengths occur."""
    mine, theirs = group or (F.substring(text, 1, 1), F.substring(other, 1, 1))
    sizes = others.filter(F.col(other) != "").groupBy(theirs.alias("__group")).agg(F.collect_set(F.length(other)).alias("__sizes"))
    asked = lookup(df.withColumn("__group", mine), sizes, ["__group"])
    fit = F.filter("__sizes", lambda n: n <= F.length(text))
    return asked.withColumn("__size", F.explode(fit)).withColumn("__prefix", F.substring(F.col(text), F.lit(1), F.col("__size"))).drop("__group", "__sizes", "__size")
