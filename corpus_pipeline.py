"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns the columns of docs; the last adds the mix's columns and gives a row for
each copy. Stage results are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common, contamination, mixing, ngram_join, pii, quality


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    del spark, sf_dir
    # the verdict stands under a name of its own, as docs may have a column "kept"
    judged = quality.judge_quality(docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("__doc")))
    return judged.filter("kept").select("__doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    del spark, sf_dir
    return ngram_join.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = common.table(spark, sf_dir, "benchmark")
    judged = contamination.decontaminate(docs.select("text", F.struct("*").alias("__doc")), items)
    return judged.filter("NOT contaminated").select("__doc.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is that of the new text."""
    del spark, sf_dir
    found = pii.find_pii(docs.select("text", F.struct("*").alias("__doc")))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[new.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    del spark, sf_dir
    return mixing.emit_copies(mixing.mix_sources(docs))


STAGES = [("quality", keep_quality), ("copies", drop_copies), ("leaks", drop_leaks), ("personal data", redact), ("mix", mix)]

#: Near copies and candidate spans have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table. Once a stage is stored, what it was made
    of goes, the stage before included."""
    docs, place = common.table(spark, sf_dir, "documents"), common.mark()
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        common.discard_since(place, docs)
    return docs
