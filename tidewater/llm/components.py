"""Connected components of an edge table."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import discard, discard_since, mark, stored

#: Rows of a task, and the most such tasks, of a table with few rows.
ROWS, TASKS = 50_000, 16


def _few(df: DataFrame, rows: int) -> bool:
    return rows // ROWS + 1 < min(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys to as few tasks as its rows need, each of bounded size; a
    table that is large enough is left to Spark, which splits a hot key."""
    return df.repartition(rows // ROWS + 1, *keys) if _few(df, rows) else df


@contextmanager
def _as_planned(spark: SparkSession):
    """Queries run as they are planned, each as one job: where rows are dealt out already
    there is nothing to adapt, and the driver would plan and report each step anew."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _stored(df: DataFrame, rows: int, tag: str) -> DataFrame:
    """stored() of what is made of a table of so many rows by _dealt()."""
    if not _few(df, rows):
        return stored(df, tag)
    with _as_planned(df.sparkSession):
        return stored(df, tag)


def _count(df: DataFrame) -> int:
    with _as_planned(df.sparkSession):
        return df.count()


def _minima(df: DataFrame, rows: int) -> DataFrame:
    """(u, m): the least v of each u. Minima of many rows are stored before they are
    joined to these: only where both sides are read by key does Spark split a hot node."""
    least = df.groupBy("u").agg(F.min("v").alias("m"))
    return least if _few(df, rows) else stored(least, "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is its component's least
    node. Large-star and small-star steps in turn (Kiveris et al., 2014): each
    links a node's neighbours to the least of them, so that every component
    becomes a star after about log n rounds. No node's neighbours are gathered:
    a step is a minimum by node and a join."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    n = _count(e)
    while True:
        # large star: neighbours greater than u go to the least of u's neighbours and u
        both = _dealt(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n, "u")
        place = mark()
        least = _minima(both, 2 * n).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: neighbours not greater than u, and u, go to the least of them
        large = _stored(_dealt(large, n, "u", "v").distinct(), 2 * n, "large")
        mine = _dealt(large, n, "u")
        low = _minima(mine, n)
        small = mine.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        after = _stored(_dealt(small, n, "u", "v").distinct(), n, "edges")
        discard_since(place, after)
        discard(e)
        # a star forest: no node has two edges to lesser ones, or one and a greater neighbour
        n = _count(after)
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = after


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links that gave roots and of more links (a, b): nodes go to
    their root first, so that few steps are left."""
    stars = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.union(links.select("a", "b")))
