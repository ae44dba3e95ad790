"""Keyed operations over whole tables: filters, merges, first and last of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.staging import stored


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row of each key: the first in the order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_per_key(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], incoming_wins: bool = True) -> DataFrame:
    """Both tables by key: columns of the winner where it has the key. `new` must
    be unique by key; null keys are equal to one another."""
    rest = [c for c in old.columns if c not in keys]
    on = None
    for k in keys:
        e = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = e if on is None else on & e
    o = old.withColumn("__o", F.lit(True)).alias("o")
    n = new.withColumn("__n", F.lit(True)).alias("n")
    win, lose, mark = ("n", "o", "__n") if incoming_wins else ("o", "n", "__o")
    pick = lambda c: F.when(F.col(f"{win}.{mark}"), F.col(f"{win}.{c}")).otherwise(F.col(f"{lose}.{c}"))
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[pick(c).alias(c) for c in rest])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of new whose key old lacks, one for each key."""
    return keep_first(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti")


def delete_by_key(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def exactly_one(df: DataFrame) -> DataFrame:
    """df, which must have at most one row; more is an error."""
    over = df.limit(2).count()
    if over > 1:
        raise ValueError("more than one row")
    return df


def in_range(df: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """Rows start to end, inclusive, in a total order."""
    return df.orderBy(*order).offset(start).limit(end - start + 1)


def like_any_case(c: Column, pattern: str) -> Column:
    """ILIKE: % and _ of the pattern are wildcards."""
    return c.ilike(pattern)


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with each row's place in a total order, from 1. Rows are dealt by ranges of
    the order and sorted there; a part's first place comes from the sizes of those
    before it, one number a part. No task sees all rows. The sorted rows are stored, as
    sizes and rows must agree; staging.release() deletes them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = stored(parts.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = parts.join(F.broadcast(sizes.select("__part", "__before")), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def shuffled(df: DataFrame, keys: list[str], seed: str, name: str = "rank") -> DataFrame:
    """df with each row's place in a random order that the seed fixes: by a digest of
    seed and keys, ties by keys. The same on each run and at any number of partitions."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return ranked(df.withColumn("__digest", F.md5(text)), ["__digest", *keys], name).drop("__digest")


def update_ids(df: DataFrame, ids: DataFrame, key: str, **values: Column) -> DataFrame:
    """df; rows whose key is among the ids get new values, made from the row."""
    marked = df.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows, each with its part's name; columns that a part lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
