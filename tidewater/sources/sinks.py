"""Sinks over Parquet: append what is new, replace, log runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.tables import insert_new


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return _fs(spark, p).exists(p)


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and counters that the action that runs it fills in: `get` has them then, and
    no second pass is made."""
    observed = Observation()
    return df.observe(observed, *[m.alias(k) for k, m in metrics.items()]), observed


def append_new(df: DataFrame, path: str, keys: list[str], order: list, bucket: Column | None = None, **metrics: Column) -> dict[str, int]:
    """Appends the rows whose key the table lacks, one for each; returns what the write
    itself counted: n_new, and further metrics of the new rows. With `bucket`, the table
    is in buckets of that key (sources.buckets)."""
    from tidewater.sources import buckets

    spark = df.sparkSession
    if _exists(spark, path):
        df = insert_new(spark.read.schema(df.schema).parquet(path), df, keys, order)
    else:
        df = insert_new(df.limit(0), df, keys, order)
    df, observed = counted(df, n_new=F.count(F.lit(1)), **metrics)
    if bucket is None:
        df.write.mode("append").parquet(path)
    else:
        buckets.append(df, path, bucket)
    return observed.get


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a streaming query with its checkpoint."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def last_batch(spark: SparkSession, path: str, query: str) -> int:
    """The number of a query's last batch that replace() has put into a table, -1 if
    none."""
    p = _path(spark, path)
    fs, begin = _fs(spark, p), f"_batch-{query}-"
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n.removeprefix(begin)) for n in names if n.startswith(begin)), default=-1)


def replace(df: DataFrame, path: str, batch: str = "") -> None:
    """Replaces a table, also one that df reads; `batch`, a query's id
    and number, is kept with the new rows. The new rows are written beside it
    first; the old table is set aside, not deleted, until the new one stands in its
    place, and recover() finishes what a crash has left."""
    new, old, aside = (_path(df.sparkSession, path + x) for x in (".new", "", ".old"))
    df.write.mode("overwrite").parquet(path + ".new")
    fs = _fs(df.sparkSession, old)
    if batch:
        fs.create(_path(df.sparkSession, f"{path}.new/_batch-{batch}")).close()
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    fs.rename(new, old)
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Brings a table back that a crash during replace() has set aside: the new rows
    if they are whole, else the old ones. Call it before a table is first read."""
    new, old, aside = (_path(spark, path + x) for x in (".new", "", ".old"))
    fs = _fs(spark, old)
    if not fs.exists(old) and fs.exists(aside):
        whole = fs.exists(_path(spark, path + ".new/_SUCCESS"))
        fs.rename(new if whole else aside, old)
    fs.delete(aside, True)


def refresh(rollup: DataFrame, path: str) -> DataFrame:
    """Stores a rollup anew, whole, and reads it back: readers see the old one or
    the new one."""
    recover(rollup.sparkSession, path)
    replace(rollup, path)
    return rollup.sparkSession.read.schema(rollup.schema).parquet(path)


def log_run(spark: SparkSession, path: str, agent: str, started: str, completed: str, status: str, found: int, detail: str = "{}") -> None:
    row = spark.range(1).select(F.lit(agent).alias("agent_name"), F.lit(status).alias("status"), F.lit(started).cast("timestamp").alias("started_at"), F.lit(completed).cast("timestamp").alias("completed_at"), F.lit(found).alias("signals_found"), F.lit(detail).alias("run_detail"))
    row.write.mode("append").parquet(path)


def last_runs(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.parquet(path)
    return r.groupBy("agent_name").agg(F.max("completed_at").alias("completed_at"), F.max_by("status", "completed_at").alias("status"))
