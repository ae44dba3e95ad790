"""Signal agents: raw records to signals, as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import dates as D
from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.functions.scores import age_score, grant_amount, previous_phase
from tidewater.operators import resolve
from tidewater.operators.enrichment import Source, enrich_deals
from tidewater.sources.readers import study_summary

c = F.col


def _seen(new: DataFrame, signals: DataFrame) -> DataFrame:
    keys = ["company_name", "signal_type", "source_url"]
    return new.join(signals.select(*keys), keys, "left_anti")


def trial_signals(studies: DataFrame, signals: DataFrame, excluded: DataFrame, dismissed: DataFrame, clients: DataFrame, as_of: str) -> DataFrame:
    """Phase transitions and new investigational drugs of industry studies in the
    United States; a company is dismissed if both kinds are (dismissed:
    company_name, signal_type)."""
    s = studies.filter((c("sponsor_class") == "INDUSTRY") & (c("nct_id") != "") & (c("sponsor") != "") & c("in_us") & ~T.has(c("sponsor"), R.ACADEMIC_TRIALS))
    s = study_summary(s).withColumnRenamed("sponsor", "company_name")
    names = s.select(c("company_name").alias("name")).distinct()
    matched = resolve.match_clients(names, clients)
    gone = resolve.excluded(names, excluded, exempt=matched).withColumnRenamed("name", "company_name")
    kinds = ("clinical_trial_phase_transition", "clinical_trial_new_ind")
    both = dismissed.filter(c("signal_type").isin(*kinds)).groupBy("company_name").agg(F.count_distinct("signal_type").alias("n")).filter("n = 2").select("company_name")
    s = s.join(gone, "company_name", "left_anti").join(both, "company_name", "left_anti")
    s = s.join(matched.select(c("name").alias("company_name"), "boost"), "company_name", "left")
    base = F.concat(F.lit("https://trials.example/study/"), c("nct_id"))
    boost = F.coalesce("boost", F.lit(0))
    moved = s.filter(c("phase.number").isin(2, 3)).select(
        "company_name", F.lit(kinds[0]).alias("signal_type"), F.concat(base, F.lit("#PHASE"), F.regexp_replace("phase.label", r"\s", "")).alias("source_url"), previous_phase(c("phase.number")).alias("phase_from"), c("phase.label").alias("phase_to"), "summary", (R.BASE_SCORES["phase_transition"] + boost).alias("priority_score"),
    )
    posted = F.coalesce(D.iso_date(c("first_posted")), D.iso_date(c("last_update")))
    fresh = (F.size("phases") == 1) & (F.upper(T.nth(c("phases"), 1)) == "PHASE1") & (posted >= F.date_sub(F.lit(as_of).cast("date"), 30))
    ind = s.filter(fresh).select("company_name", F.lit(kinds[1]).alias("signal_type"), F.concat(base, F.lit("#IND")).alias("source_url"), F.lit("Pre-Clinical").alias("phase_from"), F.lit("Phase 1").alias("phase_to"), "summary", (R.BASE_SCORES["new_ind"] + boost).alias("priority_score"))
    return _seen(moved.union(ind).dropDuplicates(["company_name", "signal_type", "source_url"]), signals)


def _allowed(items: DataFrame, rules: DataFrame | None, signal_type, **values) -> DataFrame:
    return items if rules is None else resolve.without_dismissed(items, rules, signal_type, **values)


def grant_signals(grants: DataFrame, signals: DataFrame, excluded: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Grants to industry: new awards by their activity codes, else renewals; rules
    (signal_type, rule_type, rule_value, auto_exclude) dismiss companies."""
    g = grants.filter(~F.contains(F.lower(F.coalesce("org_url", F.lit(""))), F.lit(".edu")) & (c("org_name") != "") & ~T.has(c("org_name"), R.ACADEMIC_FUNDING)).withColumnRenamed("org_name", "company_name")
    gone = resolve.excluded(g.select(c("company_name").alias("name")), excluded).withColumnRenamed("name", "company_name")
    kind = F.when(c("activity_code").isin("R43", "R41", "U43"), "funding_new_award").otherwise("funding_renewal")
    g = _allowed(g.join(gone, "company_name", "left_anti"), rules, kind, company=c("company_name"))
    out = g.select("company_name", kind.alias("signal_type"), c("project_url").alias("source_url"), F.concat(F.lit("Award of "), grant_amount(c("award_amount")), F.lit(": "), c("project_title")).alias("summary"), F.lit(R.BASE_SCORES["grant"]).alias("priority_score"))
    return _seen(out.dropDuplicates(["company_name", "signal_type", "source_url"]), signals)


def filing_signals(filings: DataFrame, bodies: DataFrame, seen_accessions: DataFrame, excluded: DataFrame, as_of: str, rules: DataFrame | None = None, posts: DataFrame | None = None, sources: tuple[Source, ...] = ()) -> DataFrame:
    """Deals of life-science filers; accessions seen in 180 days don't come again, rules
    dismiss companies before anything is asked about them. With posts and sources, deals
    are enriched, and a deal that no filing or source tells of gets a plain summary."""
    f = filings.filter(T.has(c("company_name"), R.LIFE_SCIENCES) & ~T.has(c("company_name"), R.NON_US_ENTITY, case=True) & ~T.has(c("company_name"), R.ACADEMIC_FUNDING))
    f = f.filter(T.has(c("company_name"), R.INDUSTRY) | (F.size(F.split(F.trim("company_name"), r"\s+")) <= 3))
    recent = seen_accessions.filter(c("created_at") >= F.date_sub(F.lit(as_of).cast("date"), 180)).select("accession_number")
    f = f.join(recent, "accession_number", "left_anti")
    gone = resolve.excluded(f.select(c("company_name").alias("name")), excluded).withColumnRenamed("name", "company_name")
    f = _allowed(f.join(gone, "company_name", "left_anti"), rules, F.lit("ma_transaction"), company=c("company_name"))
    f = T.with_deal(f.join(bodies.select("accession_number", "text"), "accession_number", "left"), "text", "company_name").drop("text")
    if posts is not None:
        own = f.withColumnsRenamed({"acquired_name": "counterparty", "deal_summary": "__own"})
        f = enrich_deals(own, posts, list(sources)).withColumn("acquired_name", F.coalesce("counterparty", F.lit(""))).drop("counterparty")
        f = f.withColumn("deal_summary", F.coalesce("deal_summary", F.nullif("__own", F.lit("")))).withColumn("enrichment_source", F.coalesce("enrichment_source", F.lit("sec_8k_filing"))).drop("__own")
    return f.withColumn("signal_type", F.lit("ma_transaction")).withColumn("priority_score", F.lit(R.BASE_SCORES["transaction"]))


def headline_signals(cards: DataFrame, funding_page: bool, excluded: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Deals of headlines (title, article_url): venture funds are no targets on the
    funding page, large pharma none in partnerships on the deals page; rules dismiss
    companies."""
    h = cards.withColumn("deal", T.headline_deal(c("title"))).withColumn("company_name", T.headline_company(c("title")))
    h = h.filter(c("deal").isNotNull() & (c("deal") != "ma") & ~T.has(c("title"), R.NON_US_ENTITY, case=True) & ~T.has(c("company_name"), R.ACADEMIC_FUNDING))
    h = h.filter(~T.has(c("company_name"), R.VC_FUND)) if funding_page else h.filter((c("deal") != "pharma_partnership") | ~T.has(c("company_name"), R.LARGE_PHARMA))
    gone = resolve.excluded(h.select(c("company_name").alias("name")), excluded).withColumnRenamed("name", "company_name")
    h = _allowed(h.join(gone, "company_name", "left_anti"), rules, F.lit("funding_new_award"), company=c("company_name"))
    return h.select("company_name", F.lit("funding_new_award").alias("signal_type"), c("article_url").alias("source_url"), "deal", T.amount(c("title")).alias("amount"), F.lit(R.BASE_SCORES["deal"]).alias("priority_score"))


#: Why a job card is passed over, in the order of the tests.
def reject_reason(by_client: bool = False):
    name, title = c("company"), c("title")
    role = F.lit(False) if by_client else ~T.has(title, T.role_pattern())
    return (
        F.when(c("days_posted") < 30, "too new").when(role, "role").when(T.has(title, R.EXCLUDED_ROLES), "excluded role").when(name.isin(*R.COMPETITORS), "competitor")
        .when(T.has(name, R.ACADEMIC_JOBS), "academic").when(T.has(c("location"), R.NON_US_JOBS), "location").when(T.has(name, R.CRO_JOBS), "cro").when(T.has(name, R.CONSULTING), "consulting")
        .when(T.has(name, R.CLINICAL_SITE), "clinical site").when(T.has(name, r"[^\x00-\x7F]", case=True), "not ascii").when(~T.has(name, R.PHARMA_INDICATOR), "no indicator")
    )


def stale_job_signals(cards: DataFrame, seen_urls: DataFrame, excluded: DataFrame, per_query: int = 5, per_run: int = 100, rules: DataFrame | None = None) -> DataFrame:
    """Stale jobs of cards (query_no, position, title, company, location, job_url,
    days_posted): a url counts once, at its first place, before the tests; rules dismiss
    companies, titles and places; then at most `per_query` of a query and `per_run` in
    all, caps that are the feature."""
    from tidewater.operators.tables import keep_first, top_per_key

    first = keep_first(cards.join(seen_urls.select("job_url"), "job_url", "left_anti"), ["job_url"], ["query_no", "position"])
    good = first.withColumn("reason", reject_reason()).filter("reason IS NULL").drop("reason")
    gone = resolve.excluded(good.select(c("company").alias("name")), excluded).withColumnRenamed("name", "company")
    good = _allowed(good.join(gone, "company", "left_anti"), rules, F.lit("stale_job_posting"), company=c("company"), role_title=c("title"), location=c("location"))
    some = top_per_key(good, ["query_no"], ["position"], per_query).orderBy("query_no", "position").limit(per_run)
    return some.withColumn("priority_score", age_score(c("days_posted"))).withColumn("signal_type", F.lit("stale_job_posting"))


def competitor_job_signals(cards: DataFrame, seen_urls: DataFrame, per_firm: int = 3, rules: DataFrame | None = None) -> DataFrame:
    """The first cards of each firm, then the tests and the rules for titles and
    places."""
    from tidewater.operators.tables import top_per_key

    some = top_per_key(cards, ["firm"], ["position"], per_firm)
    good = T.has(c("title"), T.role_pattern()) & ~T.has(c("title"), R.EXCLUDED_ROLES) & ~T.has(c("location"), R.NON_US_BOARD) & ~T.has(c("company"), R.CRO_BOARD)
    some = _allowed(some.filter(good), rules, F.lit("competitor_job_posting"), role_title=c("title"), location=c("location"))
    return some.join(seen_urls.select("job_url"), "job_url", "left_anti").withColumn("priority_score", F.lit(R.BASE_SCORES["competitor_job"])).withColumn("signal_type", F.lit("competitor_job_posting"))


def cleanup_rules(signals: DataFrame) -> DataFrame:
    """(id, rule) of signals to delete, by the first of eight rules; signals: id,
    signal_type, company_name, detail (JSON), source_name, source_url,
    created_at."""
    j = lambda k: F.get_json_object("detail", f"$.{k}")
    none = lambda x: F.nullif(x, F.lit(""))
    name = F.coalesce(none(c("company_name")), none(j("company_name")), none(j("sponsor")), none(j("lead_sponsor")), none(j("acquirer_name")))
    kinds = ("clinical_trial_phase_transition", "clinical_trial_new_ind", "funding_new_award", "ma_transaction")
    linked = F.contains(F.lower(F.concat_ws(" ", F.coalesce("source_name", F.lit("")), F.coalesce(j("job_board"), F.lit("")))), F.lit("linkedin"))
    key = F.coalesce(none(j("job_url")), none(c("source_url")))
    jobs = signals.filter(c("signal_type").isin("stale_job_posting", "competitor_job_posting")).withColumn("k", key)
    newest = jobs.groupBy("k").agg(F.max(F.struct("created_at", "id")).alias("b")).select(c("b.id").alias("id"), F.lit(True).alias("__newest"))
    s = signals.join(newest, "id", "left")
    is_job = c("signal_type").isin("stale_job_posting", "competitor_job_posting")
    title = F.coalesce(j("job_title"), F.lit(""))
    rule = (
        F.when(c("signal_type").isin(*kinds) & T.has(name, R.ACADEMIC_CLEANUP), "academic_government")
        .when((j("phase_from") == "Pre-Clinical") | j("phase_to").isin("?", "NA", "N/A"), "bad_phase_data")
        .when((c("signal_type") == "stale_job_posting") & ~linked, "non_linkedin_stale_jobs")
        .when(c("signal_type") == "target_company_job", "target_company_jobs")
        .when((c("signal_type") == "competitor_job_posting") & ~F.contains(F.lower(F.coalesce(j("ats_source"), F.lit(""))), F.lit("linkedin")), "non_linkedin_competitor")
        .when(is_job & T.has(title, R.GARBAGE_TITLES), "garbage_job_titles")
        .when(is_job & key.isNotNull() & c("__newest").isNull(), "duplicate_job_urls")
        .when(F.contains(title, F.lit("From Protocol to")), "career_page_garbage")
    )
    return s.withColumn("rule", rule).filter("rule IS NOT NULL").select("id", "rule")
