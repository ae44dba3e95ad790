"""A rollup of counts that is refreshed by what has changed.

Each batch leaves partial counts by key, +1 for a row that came and -1 for one that
went, under its own number. The rollup is their sum over a base, the sum of all batches
up to some number. A batch that comes again replaces its own counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.sinks import _exists, _fs, _path


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the whole tables in a folder."""
    p = _path(spark, folder)
    fs = _fs(spark, p)
    found = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(f"{name}=")) for n in found if n.startswith(f"{name}=") and _exists(spark, f"{folder}/{n}/_SUCCESS"))


def _base(spark: SparkSession, path: str) -> int:
    return max(_numbers(spark, f"{path}/base", "upto"), default=-1)


def add_batch(path: str, batch: int, keys: list[str], came: DataFrame, went: DataFrame | None = None) -> None:
    """Stores the partial counts of a batch by key: only the changed rows are read. A
    batch that the base holds already is passed over."""
    spark = came.sparkSession
    if batch <= _base(spark, path):
        return
    part = lambda df, n: df.groupBy(*keys).agg(F.sum(F.lit(n).cast("long")).alias("n"))
    delta = part(came, 1) if went is None else part(came, 1).unionByName(part(went, -1)).groupBy(*keys).agg(F.sum("n").alias("n"))
    delta.filter("n <> 0").write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, n) now: the base and the batches after it."""
    upto = _base(spark, path)
    parts = [f"{path}/base/upto={upto}"] * (upto >= 0) + [f"{path}/batches/batch={n}" for n in _numbers(spark, f"{path}/batches", "batch") if n > upto]
    if not parts:
        raise ValueError(f"no batch in {path}")
    return spark.read.parquet(*parts).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0").select(*keys, "n")


def compact(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Makes one base of all batches up to a number; what it is made of goes when it
    stands whole."""
    old = _base(spark, path)
    if upto <= old:
        return
    numbers = [n for n in _numbers(spark, f"{path}/batches", "batch") if old < n <= upto]
    parts = [f"{path}/base/upto={old}"] * (old >= 0) + [f"{path}/batches/batch={n}" for n in numbers]
    if not parts:
        return
    spark.read.parquet(*parts).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    fs = _fs(spark, _path(spark, path))
    for p in parts:
        fs.delete(_path(spark, p), True)
