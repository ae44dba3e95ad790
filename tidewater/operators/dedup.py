"""Duplicates among deal signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import dates as D
from tidewater.functions import text as T
from tidewater.functions.scores import richness

#: Deals that are compared pair by pair, newest first: part of the feature.
NEWEST = 500


def fuzzy_deals(deals: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(id): deals to delete among the newest: of a pair that names the same deal
    the poorer one, pairs in order of the list, and a deleted deal matches no
    more.

    deals: id, company, acquirer, acquired, detail (JSON), at. Pairs are found by
    a self-join of at most `newest` rows; the elimination is a fold over them."""
    top = deals.orderBy(F.col("at").desc_nulls_last(), "id").limit(newest)
    order = Window.orderBy(F.col("at").desc_nulls_last(), "id")
    t = top.select("id", "at", F.row_number().over(order).alias("i"), richness(F.col("detail")).alias("rich"), *[T.similar_name(F.col(c)).alias(c) for c in ("company", "acquirer", "acquired")])
    a, b = t.alias("a"), t.alias("b")
    s = lambda x, y: T.names_similar(F.col(x), F.col(y))
    filled = lambda *c: F.forall(F.array(*map(F.col, c)), lambda v: F.coalesce(v, F.lit("")) != "")
    near = D.days_between(F.col("a.at"), F.col("b.at")) <= 30
    same = (
        (filled("a.acquired", "b.acquired") & s("a.company", "b.acquired") & s("b.company", "a.acquired"))
        | (filled("a.acquirer", "b.acquirer") & (s("a.company", "b.acquirer") | s("b.company", "a.acquirer")) & near)
        | (s("a.acquired", "b.acquired") & s("a.acquirer", "b.acquirer"))
    )
    pairs = a.join(b, (F.col("a.i") < F.col("b.i")) & same).select(F.struct(F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.when(F.col("a.rich") >= F.col("b.rich"), F.col("b.i")).otherwise(F.col("a.i")).alias("d")).alias("p"))
    fold = F.aggregate(F.array_sort(F.collect_list("p")), F.expr("CAST(array() AS array<int>)"), lambda acc, x: F.when(F.array_contains(acc, x["i"]) | F.array_contains(acc, x["j"]), acc).otherwise(F.array_append(acc, x["d"])))
    dead = pairs.agg(fold.alias("dead")).select(F.explode("dead").alias("i"))
    return t.join(dead, "i").select("id")


def near_richest(df: DataFrame, keys: list[str], days: int = 7) -> DataFrame:
    """(id): rows within `days` of the kept row of their key, the richest and then
    newest one. A null key is a key of its own."""
    rank = F.struct(-F.col("rich"), -F.unix_micros("at"), "id")
    best = df.groupBy(*keys).agg(F.min_by(F.struct("at", "id"), rank).alias("__best"))
    on = None
    for k in keys:
        e = F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = e if on is None else on & e
    both = df.alias("d").join(best.alias("b"), on)
    return both.filter((F.col("d.id") != F.col("__best.id")) & (D.days_between(F.col("__best.at"), F.col("d.at")) <= days)).select("d.id")
