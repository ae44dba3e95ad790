"""Intermediate tables of plans in steps, in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a temporary folder, which the
    setting then names, only where it is unset on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the folder; what is written there is deleted like a stored table."""
    path = f"{folder(spark)}/tidewater/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back: computed once, whatever reads it, and safe
    from the loss of executors. Deleted when the program ends, or by release()."""
    spark = df.sparkSession
    path = place(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables stored so far; call it once what they are read for is written."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted
            return


atexit.register(release)
