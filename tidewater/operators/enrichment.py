"""Enrichment of deals from sources in order: each is asked only for what is open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.lookup import lookup
from tidewater.operators.staging import stored

c = F.col


@dataclass(frozen=True)
class Source:
    """Pages by company (company_name and what `deal` reads); deal: a struct of
    deal_value, counterparty, deal_summary and source_url, or null."""

    label: str
    pages: DataFrame
    deal: Column


def _key(name: str = "company_name") -> Column:
    return F.lower(F.trim(name))


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _asked(s: DataFrame) -> DataFrame:
    """(__ask): companies of deals that lack a value or a party."""
    return s.select("__ask").filter("__ask <> ''").distinct()


def _open() -> Column:
    return F.when(c("deal_value").isNull() | c("counterparty").isNull(), _key())


def enrich_deals(signals: DataFrame, posts: DataFrame, sources: list[Source]) -> DataFrame:
    """signals (company_name, transaction_type, deal_value, counterparty and others) with
    what posts and sources add; deal_summary and enrichment_url, their own or new ones;
    enrichment_source: filing, or the first source that knew the company; n_asked: of how
    many sources it was asked. Posts (company_name, transaction_type, source_url) give
    kinds only. A blank is as null.

    Each source's pages are read only for companies whose deals still lack a value or a
    party; when there is none left, no further source is read. A step's result is stored,
    so that the next one and its question are one computation. Of a company's several
    pages in a source, the one with the least address counts."""
    given = F.when(_some(c("deal_value")).isNotNull() | _some(c("counterparty")).isNotNull(), "filing")
    s = signals.withColumns({
        "transaction_type": _some(c("transaction_type")), "deal_value": _some(c("deal_value")), "counterparty": _some(c("counterparty")), "enrichment_source": given,
        **{x: _some(c(x)) if x in signals.columns else F.lit(None).cast("string") for x in ("deal_summary", "enrichment_url")}, "n_asked": F.lit(0), "__ask": _key(),
    })
    told = posts.groupBy(_key().alias("__ask")).agg(F.min(F.struct("source_url", "transaction_type")).alias("__d")).filter("__ask <> ''")
    s = lookup(s, told, ["__ask"])
    s = s.withColumns({
        "transaction_type": F.coalesce("transaction_type", _some(c("__d.transaction_type"))), "enrichment_url": F.coalesce("enrichment_url", "__d.source_url"),
        "enrichment_source": F.coalesce("enrichment_source", F.when(c("__d").isNotNull(), "posts")),
    }).drop("__d")
    s = stored(s.withColumn("__ask", _open()), "deals")
    for i, source in enumerate(sources):
        asked = _asked(s)
        if asked.isEmpty():
            break
        pages = source.pages.withColumn("__ask", _key()).join(asked, "__ask", "left_semi")
        found = pages.withColumn("__deal", source.deal).filter("__deal IS NOT NULL").groupBy("__ask").agg(F.min(F.struct("__deal.source_url", "__deal.deal_value", "__deal.counterparty", "__deal.deal_summary")).alias("__d"))
        s = lookup(s, found, ["__ask"])
        add = {x: F.coalesce(x, _some(c(f"__d.{x}"))) for x in ("deal_value", "counterparty", "deal_summary")}
        add["enrichment_url"] = F.coalesce("enrichment_url", _some(c("__d.source_url")))
        first = c("enrichment_source").isNull() | (c("enrichment_source") == "filing")
        add["enrichment_source"] = F.when(c("__d").isNotNull() & first, source.label).otherwise(c("enrichment_source"))
        add["n_asked"] = c("n_asked") + c("__ask").isNotNull().cast("int")
        s = s.withColumns(add).drop("__d").withColumn("__ask", _open())
        if i < len(sources) - 1:
            s = stored(s, "deals")
    return s.drop("__ask")
