"""Push sources as file streams: one JSON record a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.functions import text as T
from tidewater.operators import resolve
from tidewater.operators.state import normal, update_contacts_in_turn
from tidewater.sources import buckets, schemas, sinks


def records(spark: SparkSession, folder: str, schema: str, watermark: str = "1 day") -> DataFrame:
    return spark.readStream.schema(schema).json(folder).withWatermark("received_at", watermark)


def _run(df: DataFrame, each, checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_jobs(spark: SparkSession, folder: str, table: str, directory: str, checkpoint: str, overrides: str | None = None, blocked: str | None = None) -> StreamingQuery:
    """Jobs into a table: without blocked titles and stored urls, matched to the
    directory, with specialties. Directory, overrides and blocked titles are read
    anew for each batch, so a change holds from the next one. The table is in buckets of
    the firm's match key. A url counts once within the watermark, and once in the table:
    a row that comes later than the watermark is dropped by Spark, any other one whose url
    the table has, by the table."""
    jobs = records(spark, folder, schemas.JOBS).filter("job_title <> '' AND job_url <> ''").withColumn("job_url", T.job_url(F.col("job_url"))).dropDuplicatesWithinWatermark(["job_url"])

    def each(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        rows = batch.withColumn("title_key", T.strip(T.clean_title(F.col("job_title"))))
        if blocked:
            rows = rows.join(s.read.parquet(blocked).select(F.col("job_title_lower").alias("title_key")), "title_key", "left_anti")
        override = None
        if overrides:
            o = s.read.parquet(overrides).select(F.col("job_title_lower").alias("title_key"), F.col("specialty").alias("override"))
            rows, override = rows.join(o, "title_key", "left"), F.col("override")
        rows = rows.withColumn("specialty", T.specialties(F.col("job_title"), override))
        rows = resolve.match_company(rows.drop("title_key", "override"), s.read.parquet(directory))
        sinks.append_new(rows, table, ["job_url"], ["received_at", "job_title"], bucket=resolve.match_key(F.col("company_name")))

    return _run(jobs, each, checkpoint)


def contact_key() -> Column:
    return normal(F.col("linkedin_url"))


def ingest_contacts(spark: SparkSession, folder: str, table: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Contact updates into a snapshot in buckets of the contact's key (contact_key),
    of which a batch rewrites those that its contacts are in. A batch with several
    updates of a contact applies them one after another, in order of arrival, in one
    pass. A batch that comes again after a crash is applied once."""
    updates = records(spark, folder, schemas.CONTACT_UPDATES).filter("linkedin_url <> ''")

    def each(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        change = lambda rows: update_contacts_in_turn(rows, batch, as_of)
        buckets.update(s, table, batch, contact_key(), change, (sinks.query_id(s, checkpoint), number))

    return _run(updates, each, checkpoint)


def ingest_competitor_jobs(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Jobs of competing firms into a table: with a title and a url, each url once;
    no matching."""
    jobs = records(spark, folder, schemas.JOBS).filter("job_title <> '' AND job_url <> ''").withColumn("job_url", T.job_url(F.col("job_url"))).dropDuplicatesWithinWatermark(["job_url"])
    return _run(jobs, lambda batch, _: sinks.append_new(batch, table, ["job_url"], ["received_at", "job_title"]), checkpoint)


def ingest_lead_contacts(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Contacts of leads into a table: with a name and a company, each profile once
    (those without one by name and company), with specialties of their titles."""
    rows = records(spark, folder, schemas.LEAD_CONTACTS).filter("full_name <> '' AND company_name <> ''")
    key = F.coalesce(F.nullif(T.plain_url(F.col("linkedin_url")), F.lit("")), F.concat_ws("|", F.lower(F.trim("full_name")), F.lower(F.trim("company_name"))))
    rows = rows.withColumn("contact_key", key).withColumn("specialty", T.specialties(F.col("job_title"), None))
    return _run(rows, lambda batch, _: sinks.append_new(batch, table, ["contact_key"], ["received_at", "full_name"]), checkpoint)


def ingest_companies(spark: SparkSession, folder: str, directory: str, jobs: str, checkpoint: str) -> StreamingQuery:
    """Companies into the directory, then stored jobs without a match are matched
    again: a new company fits names of its own match key only, so that only these keys'
    buckets of the jobs are rewritten. A batch that comes again is applied once: the
    directory takes what it lacks, and the jobs know the batch."""
    companies = records(spark, folder, schemas.COMPANIES).filter("name <> ''")

    def each(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        new = batch.select("name", F.col("company_size").alias("size"), "domain").dropDuplicates(["name"])
        sinks.append_new(new, directory, ["name"], ["size"])

        def change(rows: DataFrame) -> DataFrame:
            open_ = rows.filter("matched_name IS NULL").drop("matched_name", "matched_via")
            return rows.filter("matched_name IS NOT NULL").unionByName(resolve.match_company(open_, new))

        keys = new.select(F.col("name").alias("company_name"))
        buckets.update(s, jobs, keys, resolve.match_key(F.col("company_name")), change, (sinks.query_id(s, checkpoint), number))

    return _run(companies, each, checkpoint)


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key, with late rows up to a delay."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
