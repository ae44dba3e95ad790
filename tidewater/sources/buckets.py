"""Snapshots in buckets of a key: an update rewrites the buckets that it touches only.

A table is a folder with a subfolder for each bucket (bucket=...). A batch's new rows
are written beside the table first; then they replace their buckets by Spark's dynamic
partition overwrite, and the batch's number is kept. After a crash, what has been
written whole is only put in place again, so a batch is applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.sinks import _exists, _fs, _path, last_batch

BUCKETS = 64


def with_bucket(df: DataFrame, key: Column, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def create(df: DataFrame, path: str, key: Column, buckets: int = BUCKETS) -> None:
    _write(with_bucket(df, key, buckets), path, "error")


def _write(df: DataFrame, path: str, mode: str, overwrite: str = "static") -> None:
    """A file or a few for each bucket. Only a static write marks its folder as whole."""
    df.repartition("bucket").write.mode(mode).partitionBy("bucket").option("partitionOverwriteMode", overwrite).parquet(path)


def append(df: DataFrame, path: str, key: Column, buckets: int = BUCKETS) -> None:
    _write(with_bucket(df, key, buckets), path, "append")


def update(spark: SparkSession, path: str, keys: DataFrame, key: Column, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> list[int]:
    """Replaces the buckets of the table that hold these keys (a column of `keys`) by
    change() of their rows, which keeps their bucket; returns the buckets. `batch`, a streaming query's id and the
    batch's number: it is passed over if it, or a later one, is in the table.

    A bucket that change() leaves without rows stays as it was: rows are changed, not
    deleted, by an update."""
    if batch and last_batch(spark, path, batch[0]) >= batch[1]:
        return []
    beside = f"{path}.{batch[0]}-{batch[1]}" if batch else f"{path}.new"
    # at most `buckets` numbers
    hit = sorted(r[0] for r in with_bucket(keys, key, buckets).select("bucket").distinct().collect())
    if not hit:
        return []
    fs = _fs(spark, _path(spark, path))
    if not (batch and _exists(spark, beside + "/_SUCCESS")):
        fs.delete(_path(spark, beside), True)
        rows = spark.read.parquet(path).filter(F.col("bucket").isin(hit))
        _write(change(rows), beside, "overwrite")
    _write(spark.read.parquet(beside), path, "overwrite", "dynamic")
    if batch:
        fs.create(_path(spark, f"{path}/_batch-{batch[0]}-{batch[1]}"), True).close()
        for n in [f.getPath() for f in fs.listStatus(_path(spark, path)) if f.getPath().getName().startswith(f"_batch-{batch[0]}-")]:
            if int(n.getName().rpartition("-")[2]) < batch[1]:
                fs.delete(n, False)
    fs.delete(_path(spark, beside), True)
    return hit
