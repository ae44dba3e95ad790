"""The driver tables in the roles that the queries read: the same expressions in
Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-08-01"


def _name(key: str) -> str:
    """The directory's name of a customer key."""
    return f"CASE {key} % 8 WHEN 0 THEN 'Acme ' || {key} || ', Inc.' WHEN 1 THEN 'Beta Therapeutics ' || {key} || ' Corp.' WHEN 2 THEN 'The Gamma ' || {key} || ' (US) LLC' WHEN 3 THEN 'Delta Bio ' || {key} || ' /DE/' WHEN 4 THEN {key} || ' University Hospital' WHEN 5 THEN 'Costco ' || {key} || ' Co., Ltd.' WHEN 6 THEN 'Epsilon Clinical Research ' || {key} ELSE 'Zeta ' || ({key} % 50) END"


def _matched(key: str, id_: str) -> dict[str, str]:
    """A matched record: now and then without a match, companies of all sizes."""
    return {"matched_name": f"CASE WHEN {id_} % 10 = 9 THEN NULL ELSE {_name(key)} END", "company_size": f"CASE {id_} % 4 WHEN 0 THEN '10,001+ employees' WHEN 1 THEN '10,001+' WHEN 2 THEN '51-200 employees' END"}


def _events(kind: str) -> tuple:
    return ("events", {"id": "event_id", **_matched("user_id", "event_id"), "title": "props", "created_at": "CAST(ts AS TIMESTAMP)"}, f"event_type = '{kind}'")


def _orders(where: str, more: dict[str, str]) -> tuple:
    return ("orders", {"id": "o_orderkey", **_matched("o_custkey", "o_orderkey"), "created_at": "CAST(o_orderdate AS TIMESTAMP)", **more}, where)


def _articles(rest: int) -> tuple:
    day = "CAST('2024-01-' || lpad((doc_id % 28 + 1) || '', 2, '0') AS TIMESTAMP)"
    return ("documents", {"id": "doc_id", "title": "split_part(text, chr(10), 1)", "names": f"{_name('(doc_id % 150)')} || '|' || {_name('(doc_id % 149)')}", "created_at": day}, f"doc_id % 3 = {rest}")


def _people(table: str, key: str) -> tuple:
    return (table, {
        "id": key, "original_title": f"CASE WHEN {key} % 5 = 0 THEN NULL ELSE 'CRA' END", "current_title": f"CASE {key} % 3 WHEN 0 THEN ' cra ' WHEN 1 THEN 'Lead' ELSE 'CRA' END",
        "original_company": _name(key), "current_company": f"CASE {key} % 4 WHEN 0 THEN 'Elsewhere' ELSE upper({_name(key)}) END",
    }, "true")

_EXPR = {
    # customers as the company directory
    "directory": ("customer", {
        "id": "c_custkey",
        "name": _name("c_custkey"),
        "size": "CASE WHEN c_acctbal > 8000 THEN '10,001+ employees' WHEN c_acctbal > 6000 THEN '10,001+' WHEN c_acctbal > 3000 THEN '1,001-5,000 employees' WHEN c_acctbal > 0 THEN '51-200 employees' WHEN c_acctbal > -500 THEN 'Self-employed' END",
        "domain": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'C' || (c_custkey % 400) || '.example.com' END",
        "industry": "c_mktsegment",
        "country": "CAST(c_nationkey AS INT)",
    }),
    # events as signals
    "signals": ("events", {
        "id": "event_id",
        "company_id": "user_id % 1000",
        "signal_type": "CASE event_type WHEN 'signup' THEN 'clinical_trial_new_ind' WHEN 'purchase' THEN 'ma_transaction' WHEN 'error' THEN 'stale_job_posting' WHEN 'view' THEN 'funding_new_award' ELSE 'competitor_job_posting' END",
        "signal_detail": "props",
        "priority_score": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END",
        "first_detected_at": "CAST(ts AS TIMESTAMP)",
        "source_url": "'https://jobs.example/' || (event_id % 700) || '?ref=' || event_id",
        "status": "CASE WHEN event_id % 5 = 0 THEN 'dismissed' WHEN event_id % 7 = 0 THEN 'carried_forward' ELSE 'new' END",
    }),
    # orders as filings, their customers the matched companies
    "filings": ("orders", {
        "id": "o_orderkey",
        "company_id": "o_custkey",
        "form": "CASE WHEN o_orderstatus = 'P' THEN 'S-1' ELSE '8-K' END",
        "value": "o_totalprice",
        "filing_date": "CAST(o_orderdate AS DATE)",
        "created_at": "CAST(o_orderdate AS TIMESTAMP)",
        "kind": "o_orderpriority",
    }),
    # suppliers as past clients, in order of rank
    "clients": ("supplier", {
        "id": "s_suppkey",
        "name": "CASE s_suppkey % 4 WHEN 0 THEN 'Acme ' || (s_suppkey * 2) || ' Inc.' WHEN 1 THEN 'beta therapeutics ' || (s_suppkey * 8 + 1) || ' corp.' WHEN 2 THEN 'Zeta ' || s_suppkey ELSE 'Epsilon Clinical Research ' || (s_suppkey * 2) || ', LLC' END",
        "rank": "CAST(s_suppkey AS INT)",
        "is_active": "s_suppkey % 10 <> 0",
    }),
    # documents as news, by source
    "news": ("documents", {
        "id": "doc_id",
        "title": "split_part(text, chr(10), 1)",
        "body": "text",
        "source": "source",
        "url": "'https://news.example/1998/' || (doc_id % 12 + 1) || '/' || (doc_id % 31 + 1) || '/' || doc_id",
        "n_chars": "n_chars",
    }),
    # records that are matched to the directory
    "trials": _events("signup"), "funding": _events("purchase"), "jobs": _events("error"), "competitor_jobs": _events("click"),
    "eight_k": _orders("o_orderstatus <> 'P'", {"items": "CASE o_orderkey % 3 WHEN 0 THEN '1.01,9.01' WHEN 1 THEN '8.01' END", "agreement_type": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END"}),
    "s1": _orders("o_orderstatus = 'P'", {}),
    "news_a": _articles(0), "news_b": _articles(1), "news_c": _articles(2),
    "buyers": _people("customer", "c_custkey"), "candidates": _people("supplier", "s_suppkey"),
    "contacts": ("customer", {"id": "c_custkey", "company_name": f"upper({_name('c_custkey')})", "created_at": "CAST('2024-01-' || lpad((c_custkey % 28 + 1) || '', 2, '0') AS TIMESTAMP)"}, "c_custkey % 6 <> 5"),
    "past_clients": ("supplier", {"id": "s_suppkey", "name": "'Client ' || s_suppkey", "matched_name": f"CASE WHEN s_suppkey % 3 = 0 THEN {_name('s_suppkey')} END", "is_active": "s_suppkey % 10 <> 0"}, "true"),
    # four lists of tracked companies
    **{f"leads_{p}": ("customer", {"name": _name("c_custkey")}, f"c_acctbal > {5000 + 1000 * i}") for i, p in enumerate(("a", "b", "c", "d"))},
    "accounts": ("customer", {"leads_page": "CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'none' END", "development_stage": "CASE c_nationkey % 6 WHEN 0 THEN 'Prospecting' WHEN 1 THEN 'Engaged' WHEN 2 THEN 'Active' WHEN 3 THEN 'MSA Sent' WHEN 4 THEN 'MSA Signed' END", "momentum": "CASE c_custkey % 7 WHEN 0 THEN 'Drive' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Reverse' WHEN 3 THEN 'Park' ELSE 'Other' END"}, "true"),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    table, columns, *where = _EXPR[role]
    return read(spark, sf_dir, table).filter(where[0] if where else "true").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def cte(*roles: str) -> str:
    """WITH clause of the same views for DuckDB."""
    each = lambda table, columns, where="true": f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} WHERE {where}"
    return "WITH " + ", ".join(f"{r} AS ({each(*_EXPR[r])})" for r in roles) + " "
