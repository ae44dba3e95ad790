"""What the pages show: feeds of matched records, a company's records, leads,
counts. Tables are given; each result is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions.dates import week_cutoff
from tidewater.operators.state import normal
from tidewater.operators.tables import union_tagged

c = F.col
#: The item of a current report that tells of a deal.
DEAL_ITEM = "1.01"


def _low(x: str) -> Column:
    return F.lower(F.coalesce(c(x), F.lit("")))


def client_names(clients: DataFrame) -> DataFrame:
    """(k): names of active past clients and of what they are matched to, in lower
    case, each once."""
    active = clients.filter("is_active")
    return active.select(_low("name").alias("k")).union(active.select(_low("matched_name"))).filter("k <> ''").distinct()


def without_large(df: DataFrame, clients: DataFrame, labels: tuple[str, ...] = R.BIG_LABELS) -> DataFrame:
    """Rows (matched_name, company_size) but those of very large companies that are
    no past clients."""
    known = client_names(clients).withColumn("__client", F.lit(True))
    large = F.coalesce(c("company_size"), F.lit("")).isin(*labels)
    # only large companies' rows look for a client
    rows = df.withColumn("k", F.when(large, _low("matched_name"))).join(known, "k", "left")
    return rows.filter(~large | F.coalesce("__client", F.lit(False))).drop("k", "__client")


def deal_filings(eight_k: DataFrame, s1: DataFrame) -> DataFrame:
    """Current reports of deals and registrations, with form and transaction."""
    deals = eight_k.filter(F.array_contains("items", DEAL_ITEM)).withColumn("transaction", F.coalesce(F.nullif(c("agreement_type"), F.lit("")), F.lit("Other")))
    return union_tagged({"8-K": deals.drop("items", "agreement_type"), "S-1": s1.withColumn("transaction", F.lit("IPO"))}, "form")


def trials_feed(trials: DataFrame, clients: DataFrame) -> DataFrame:
    return without_large(trials, clients, R.BIG_LABELS_STRICT)


def filings_feed(eight_k: DataFrame, s1: DataFrame, clients: DataFrame) -> DataFrame:
    return without_large(deal_filings(eight_k, s1), clients, R.BIG_LABELS_STRICT)


def funding_feed(projects: DataFrame, clients: DataFrame) -> DataFrame:
    return without_large(projects.filter("matched_name <> ''"), clients)


def jobs_feed(jobs: DataFrame, clients: DataFrame) -> DataFrame:
    return without_large(jobs, clients)


def news_feed(tables: dict[str, DataFrame]) -> DataFrame:
    """All articles of the news tables, each with its table's name."""
    return union_tagged(tables, "source")


def company_detail(company: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(source, id, title, at): one company's records of ten sources: trials,
    eight_k (deals only), s1, funding, jobs by matched name, three news tables by
    one of their names, buyers and candidates who work there now, in any case; and
    past clients, all of them. Titles and days that a source lacks are null."""
    own = {k: tables[k].filter(c("matched_name") == company) for k in ("trials", "eight_k", "s1", "funding", "jobs")}
    own["eight_k"] = own["eight_k"].filter(F.array_contains("items", DEAL_ITEM))
    news = {k: t.filter(F.array_contains("matched_names", company)) for k, t in tables.items() if k.startswith("news_")}
    people = {k: tables[k].filter(c("current_company").ilike(company.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_"))) for k in ("buyers", "candidates")}
    parts = {**own, **news, **people, "clients": tables["clients"].filter("is_active AND name <> ''")}
    title = lambda t: c("title") if "title" in t.columns else F.lit(None).cast("string")
    at = lambda t: c("created_at") if "created_at" in t.columns else F.lit(None).cast("timestamp")
    return union_tagged({k: t.select("id", title(t).alias("title"), at(t).alias("at")) for k, t in parts.items()}, "source").select("source", "id", "title", "at")


def leads_page(tracked: DataFrame, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """(feed, id, company, created_at, is_new): records of tracked companies (name):
    trials, filings, funding, jobs by matched name, news by any of their names
    (company: the article's least tracked one), contacts by company in any case.
    is_new: since seven days before the last midnight at UTC-5."""
    names = tracked.select(c("name").alias("company")).filter("company <> ''").distinct()
    # one list of keys for both ways to match, so that all feeds but news are one join
    any_case = lambda x: F.concat(F.lit("any case|"), F.lower(x))
    keys = names.select(F.concat(F.lit("name|"), "company").alias("__k")).union(names.select(any_case("company"))).distinct()
    by_name = lambda t: t.select("id", c("matched_name").alias("company"), "created_at", F.concat(F.lit("name|"), "matched_name").alias("__k"))
    contacts = tables["contacts"].select("id", c("company_name").alias("company"), "created_at", any_case("company_name").alias("__k"))
    parts = {"trials": by_name(tables["trials"]), "filings": by_name(deal_filings(tables["eight_k"], tables["s1"])), "funding": by_name(tables["funding"]), "jobs": by_name(tables["jobs"]), "contacts": contacts}
    matched = union_tagged(parts, "feed").join(keys, "__k", "left_semi").select("feed", "id", "company", "created_at")
    news = news_feed({k: t.select("id", "matched_names", "created_at") for k, t in tables.items() if k.startswith("news_")})
    news = news.select("source", "id", "created_at", F.explode("matched_names").alias("company")).join(names, "company", "left_semi")
    news = news.groupBy("source", "id", "created_at").agg(F.min("company").alias("company"))
    rows = matched.unionByName(news.select(F.lit("news").alias("feed"), "id", "company", "created_at"))
    return rows.select("feed", "id", "company", "created_at", F.coalesce(c("created_at") >= week_cutoff(as_of), F.lit(False)).alias("is_new"))


def new_counts(leads: DataFrame) -> DataFrame:
    """(feed, n, n_new) of a leads page."""
    return leads.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("n_new"))


def changed_people(people: DataFrame) -> DataFrame:
    """People whose company or role is another than it was, in any case."""
    other = lambda x: normal(c(f"original_{x}")) != normal(c(f"current_{x}"))
    return people.filter(other("company") | other("title"))


def badge_counts(tables: dict[str, DataFrame], leads: dict[str, DataFrame]) -> DataFrame:
    """(badge, n): what each page would show, 0 for none: a row for each leads list
    and for trials, deals, funding, jobs, competitor jobs, news, changed buyers and
    changed candidates."""
    sized = lambda t: t.select("matched_name", "company_size")
    deals = sized(tables["eight_k"].filter(F.array_contains("items", DEAL_ITEM))).unionByName(sized(tables["s1"]))
    # the feeds without large companies look for clients together, and all rows are counted together
    feeds = union_tagged({"trials": sized(tables["trials"]), "deals": deals, "funding": sized(tables["funding"].filter("matched_name <> ''")), "jobs": sized(tables["jobs"])}, "badge")
    others = {f"leads_{k}": t for k, t in leads.items()} | {
        "competitor_jobs": tables["competitor_jobs"], "news": news_feed({k: t.select("id") for k, t in tables.items() if k.startswith("news_")}),
        "buyers": changed_people(tables["buyers"]), "candidates": changed_people(tables["candidates"]),
    }
    rows = without_large(feeds, tables["clients"]).select("badge")
    for badge, t in others.items():
        rows = rows.union(t.select(F.lit(badge)))
    badges = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("trials", "deals", "funding", "jobs", *others)])).alias("badge"))
    counts = rows.groupBy("badge").agg(F.count(F.lit(1)).alias("n"))
    return badges.join(counts, "badge", "left").select("badge", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


#: Stages and momenta of accounts (fixed values), and the columns that count them.
STAGES = {"Prospecting": "prospecting", "Engaged": "engaged", "Active": "active", "MSA Sent": "msa_sent", "MSA Signed": "msa_signed"}
MOMENTA = {"Drive": "drive", "Neutral": "neutral", "Reverse": "reverse", "Park": "park"}


def crm_summary(accounts: DataFrame, leads: dict[str, DataFrame]) -> DataFrame:
    """(person, total_targets, a count for each stage and momentum): a row for each
    leads list, by the accounts (leads_page, development_stage, momentum) that were
    pushed from it."""
    targets = union_tagged({k: t.agg(F.count(F.lit(1)).alias("total_targets")) for k, t in leads.items()}, "person")
    one = lambda col, v: F.count_if(c(col) == v)
    counts = accounts.groupBy(c("leads_page").alias("person")).agg(*[one("development_stage", k).alias(v) for k, v in STAGES.items()], *[one("momentum", k).alias(v) for k, v in MOMENTA.items()])
    names = [*STAGES.values(), *MOMENTA.values()]
    return targets.join(counts, "person", "left").select("person", "total_targets", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


ACTIVE = ("new", "carried_forward", "claimed", "contacted")


def active_signals(signals: DataFrame, companies: DataFrame) -> DataFrame:
    """Signals in work with their companies (id, name, domain, industry), which may
    be missing."""
    s = signals.filter(c("status").isin(*ACTIVE))
    return s.join(companies.select(c("id").alias("company_id"), c("name").alias("company_name"), c("domain").alias("company_domain"), c("industry").alias("company_industry")), "company_id", "left")


def signal_stats(signals: DataFrame, day: Column) -> DataFrame:
    """(total_active, new_today, claimed) of the signals in work."""
    s = signals.filter(c("status").isin(*ACTIVE))
    return s.agg(F.count(F.lit(1)).alias("total_active"), F.count_if(c("first_detected_at").cast("date") == day).alias("new_today"), F.count_if(F.trim("claimed_by") != "").alias("claimed"))


def patch_signals(signals: DataFrame, patches: DataFrame) -> DataFrame:
    """signals (id, status, claimed_by, detail: map) with one patch an id at most:
    (id, status, claimed_by, notes, dismissal_reason, dismissal_value,
    inferred_client, claimed_at), null for what stays. The last five go into the
    detail; a dismissal's value and a claim's person go with it."""
    p = patches.select(c("id"), *[c(x).alias(f"p_{x}") for x in ("status", "claimed_by", "notes", "dismissal_reason", "dismissal_value", "inferred_client", "claimed_at")])
    entry = lambda on, key, value: F.when(c(on).isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))
    new = F.array(
        entry("p_notes", "rep_notes", c("p_notes")), entry("p_dismissal_reason", "dismissal_reason", c("p_dismissal_reason")), entry("p_dismissal_reason", "dismissal_value", c("p_dismissal_value")),
        entry("p_inferred_client", "inferred_client", c("p_inferred_client")), entry("p_claimed_at", "claimed_at", c("p_claimed_at")), entry("p_claimed_at", "claimed_by", F.coalesce("p_claimed_by", F.lit(""))),
    )
    new = F.map_from_entries(F.filter(new, lambda e: e.isNotNull()))
    both = signals.join(p, "id", "left")
    old = F.map_filter(F.coalesce("detail", F.expr("CAST(map() AS map<string, string>)")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    detail = F.when(F.size(new) > 0, F.map_concat(old, new)).otherwise(c("detail"))
    return both.select(*[{"status": F.coalesce("p_status", "status"), "claimed_by": F.coalesce("p_claimed_by", "claimed_by"), "detail": detail}.get(x, c(x)).alias(x) for x in signals.columns])


def contacts_summary(people: DataFrame) -> DataFrame:
    """(total, last_enrichment_date, company_changes, role_changes) of a list of
    people."""
    other = lambda x: normal(c(f"original_{x}")) != normal(c(f"current_{x}"))
    return people.agg(F.count(F.lit(1)).alias("total"), F.max("last_enrichment_date").alias("last_enrichment_date"), F.count_if(other("company")).alias("company_changes"), F.count_if(other("title")).alias("role_changes"))


def assign_news(articles: DataFrame, assignments: DataFrame) -> DataFrame:
    """articles (article_url, matched_names) with the names of assignments
    (article_url, company_names), one for each url at most: trimmed, without blank
    ones, null if none is left."""
    names = F.filter(F.transform("company_names", lambda n: F.trim(F.coalesce(n, F.lit("")))), lambda n: n != "")
    new = assignments.select("article_url", F.when(F.size(names) > 0, names).alias("__names"), F.lit(True).alias("__new"))
    out = articles.join(new, "article_url", "left")
    return out.select(*[(F.when(c("__new"), c("__names")).otherwise(c(x)) if x == "matched_names" else c(x)).alias(x) for x in articles.columns])


def upsert_alternates(alternates: DataFrame, entries: DataFrame) -> DataFrame:
    """alternates (alternate_name, directory_name, matched_via) with entries
    (alternate_name, directory_name) from the news page, by alternate name, trimmed;
    entries without either name are passed over, of several the least counts."""
    new = entries.select(F.trim("alternate_name").alias("alternate_name"), F.trim("directory_name").alias("directory_name")).filter("alternate_name <> '' AND directory_name <> ''")
    new = new.groupBy("alternate_name").agg(F.min("directory_name").alias("directory_name")).withColumn("matched_via", F.lit("news_page_entry"))
    return alternates.join(new.select("alternate_name"), "alternate_name", "left_anti").select("alternate_name", "directory_name", "matched_via").unionByName(new)


def submission_checks(urls: DataFrame, directory: DataFrame) -> DataFrame:
    """urls (url) with outcome: invalid_url, already_exists (and the company, of
    several the least name) or accepted; urls are compared in lower case and without
    slashes at the end."""
    plain = F.regexp_replace(F.lower(F.trim("url")), r"/+\z", "")
    valid = F.trim("url").rlike(R.COMPANY_PAGE)
    known = directory.select(F.regexp_replace(F.lower(F.trim("linkedin_url")), r"/+\z", "").alias("k"), "name").groupBy("k").agg(F.min("name").alias("company_name"))
    out = urls.withColumn("k", F.when(valid, plain)).join(known, "k", "left")
    return out.select("url", F.when(~F.coalesce(valid, F.lit(False)), "invalid_url").when(c("company_name").isNotNull(), "already_exists").otherwise("accepted").alias("outcome"), "company_name")
