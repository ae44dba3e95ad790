"""Readers of files as the services return them; fetching is not part of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import dates as D
from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.functions.scores import phase
from tidewater.sources import schemas

c = F.col


def studies(spark: SparkSession, path: str) -> DataFrame:
    """One row for each study of paged JSON files, flattened, with defaults."""
    return _studies(spark.read.schema(schemas.STUDIES).option("multiLine", True).json(path))


def studies_updated(spark: SparkSession, path: str, as_of: str, days: int = 30, chunk_days: int = 7) -> DataFrame:
    """Studies with a place in the United States, or none, that were updated in the days
    before a date, from pages in folders chunk=<first day of a chunk>."""
    day = F.lit(as_of).cast("date")
    pages = saved_pages(spark, path, schemas.STUDIES, "chunk date").filter(c("chunk").between(F.date_sub(day, days + chunk_days - 1), day))
    return _studies(pages).filter(c("in_us") & D.iso_date(c("last_update")).between(F.date_sub(day, days), day))


def _studies(raw: DataFrame) -> DataFrame:
    s = raw.select(F.explode("studies").alias("s")).select("s.protocolSection.*")
    m = lambda x: c(x)
    text = lambda x: F.coalesce(m(x), F.lit(""))
    locations = m("contactsLocationsModule.locations")
    return s.select(
        text("identificationModule.nctId").alias("nct_id"), text("identificationModule.briefTitle").alias("brief_title"), text("identificationModule.officialTitle").alias("official_title"),
        text("sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"), text("sponsorCollaboratorsModule.leadSponsor.class").alias("sponsor_class"), text("statusModule.overallStatus").alias("overall_status"),
        m("statusModule.startDateStruct.date").alias("study_start_date"), m("statusModule.studyFirstPostDateStruct.date").alias("first_posted"), m("statusModule.lastUpdatePostDateStruct.date").alias("last_update"),
        m("designModule.phases").alias("phases"), m("designModule.enrollmentInfo.count").alias("enrollment"), F.transform(m("conditionsModule.meshes"), lambda x: x["term"]).alias("mesh_terms"),
        m("conditionsModule.conditions").alias("conditions"), T.nth(F.transform(m("armsInterventionsModule.interventions"), lambda x: x["name"]), 1).alias("intervention"),
        m("oversightModule.isFdaRegulatedDrug").alias("is_fda_regulated_drug"), m("oversightModule.isFdaRegulatedDevice").alias("is_fda_regulated_device"),
        F.coalesce(m("contactsLocationsModule.centralContacts"), F.expr("CAST(array() AS array<struct<name: string, phone: string, email: string>>)")).alias("central_contacts"),
        (F.coalesce(F.size(locations), F.lit(0)).isin(0, -1) | F.coalesce(F.exists(locations, lambda x: x["country"] == "United States"), F.lit(False))).alias("in_us"),
    )


def late_phase(df: DataFrame) -> DataFrame:
    """Studies that list phase 2 or 3."""
    return df.filter(F.exists("phases", lambda p: F.upper(p).isin("PHASE2", "PHASE3")))


def starting_near(df: DataFrame, as_of: str) -> DataFrame:
    """Studies that start from a month before to a year after a day."""
    day = F.lit(as_of).cast("date")
    return df.filter(F.coalesce(D.iso_date(c("study_start_date")), F.try_to_date("study_start_date", "yyyy-MM")).between(F.add_months(day, -1), F.add_months(day, 12)))


def study_summary(df: DataFrame) -> DataFrame:
    none = lambda x: F.nullif(x, F.lit(""))
    condition = F.coalesce(none(T.nth(c("mesh_terms"), 1)), none(c("official_title")), none(c("brief_title")), F.lit("an undisclosed indication"))
    return df.withColumn("summary", F.concat(condition, F.lit(" evaluating "), F.coalesce(none(c("intervention")), F.lit("an investigational agent")))).withColumn("phase", phase(c("phases")))


def grants(spark: SparkSession, path: str, project_url: str = "https://grants.example/project/") -> DataFrame:
    g = spark.read.schema(schemas.GRANTS).option("multiLine", True).json(path).select(F.inline("results"))
    return g.select(
        "appl_id", "project_num", "project_title", c("organization.org_name").alias("org_name"), c("organization.org_city").alias("org_city"), c("organization.org_state").alias("org_state"), c("organization.org_url").alias("org_url"),
        F.coalesce("award_amount", "total_cost").alias("award_amount"), c("phr_text").alias("public_health_relevance"), "fiscal_year", D.iso_date(c("award_notice_date")).alias("award_notice_date"), D.iso_date(c("date_added")).alias("date_added"),
        "activity_code", F.concat(F.lit(project_url), c("appl_id")).alias("project_url"),
    )


def recent_grants(df: DataFrame, as_of: str, days: int, codes: tuple[str, ...] = (), years: tuple[int, ...] = (), org_type: str = "") -> DataFrame:
    """Grants of the last days, of these activity codes, fiscal years and kind of
    organisation where given; newest first."""
    day = F.lit(as_of).cast("date")
    df = df.filter(c("award_notice_date").between(F.date_sub(day, days), day))
    df = df.filter(c("activity_code").isin(*codes)) if codes else df
    df = df.filter(c("fiscal_year").isin(*years)) if years else df
    df = df.filter(F.upper("org_type") == org_type.upper()) if org_type else df
    return df.orderBy(c("date_added").desc(), "appl_id")


def saved_pages(spark: SparkSession, path: str, schema: str, by: str) -> DataFrame:
    """Saved pages of a service, a page a line, in folders that name what was asked for (`by`, such as
    "form string, chunk date"): a filter on these columns picks the folders, and pages
    outside of it are never opened."""
    return spark.read.schema(f"{schema}, {by}").json(path)


def filings(spark: SparkSession, path: str) -> DataFrame:
    return _filings(spark.read.schema(schemas.FILINGS).option("multiLine", True).json(path))


def filings_of(spark: SparkSession, path: str, forms: tuple[str, ...], as_of: str, days: int, chunk_days: int = 7) -> DataFrame:
    """Filings of these forms in the days before a date, from pages in folders form=.../
    chunk=<first day of a chunk>."""
    day = F.lit(as_of).cast("date")
    pages = saved_pages(spark, path, schemas.FILINGS, "form string, chunk date")
    pages = pages.filter(c("form").isin(*forms) & c("chunk").between(F.date_sub(day, days + chunk_days - 1), day))
    return _filings(pages, "form").filter(c("filing_date").between(F.date_sub(day, days), day))


def _filings(pages: DataFrame, *more: str) -> DataFrame:
    h = pages.select(F.explode("hits.hits").alias("h"), *more).select("h._source.*", *more)
    name = T.display_name(T.nth(c("display_names"), 1))
    return h.select(
        T.nth(c("ciks"), 1).alias("company_cik"), name["name"].alias("company_name"), name["ticker"].alias("ticker"), D.iso_date(c("file_date")).alias("filing_date"), c("adsh").alias("accession_number"),
        T.filing_url(T.nth(c("ciks"), 1), c("adsh")).alias("filing_url"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"), *more,
    )


def filing_text(document, plain, chars: int = 5000):
    """A filing's text, of its main document or, where that has none, of its .txt file."""
    some = lambda x: F.nullif(plain_text(x, chars), F.lit(""))
    return F.coalesce(some(document), some(plain), F.lit(""))


def filing_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, item_summary, agreement_type) of filings of several documents."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), T.document_body(c("value")).alias("body"))
    return t.withColumn("item_summary", T.item_summary(c("body"))).withColumn("agreement_type", T.agreement_kind(c("item_summary")))


def plain_text(html, chars: int):
    """A page's text: scripts, styles and tags are a space each, cut to a length."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.substring(T.squeeze(T.decode_entities(T.strip_tags(x, " "))), 1, chars)


#: Card layouts (fixed values): where a card begins, what its title's tag ends with,
#: what its link's tag must have, the date's tag, whether dates are relative.
CARDS = {
    "promo": (r'(?is)<div\s+class="PagePromo-title"[^>]*>', "</div>", r'(?=[^>]*class="[^"]*\bLink\b)', r'(?is)<div\s+class="PagePromo-date"[^>]*>(.*?)</div>', False),
    "heading": (r'(?is)<h3\s+class="element-title[^"]*"[^>]*>', "</h3>", "", r'(?is)<span\s+class="date\s+d-inline-block"[^>]*>(.*?)</span>', False),
    "relative": (r'(?is)<div\s+class="[^"]*\bepn_item\b[^"]*"[^>]*>', "</h3>", "", r'(?is)<div\s+class="[^"]*\bepn_time\b[^"]*"[^>]*>(.*?)</div>', True),
}


def listed_cards(pages: DataFrame, html: str, layout: str, as_of: str, origin: str = "") -> DataFrame:
    """(at, title, article_url, article_date): each card of the pages, however often its
    url occurs. A date is looked for between a title and the next; a title attribute of
    a link comes before its text, and links within the site get its origin."""
    head, end, must, date, relative = CARDS[layout]
    parts = pages.select(F.posexplode(F.split(F.concat(F.lit(" "), c(html)), head)).alias("at", "part")).filter("at > 0")
    clean = lambda x: T.squeeze(T.decode_entities(T.strip_tags(x), layout))
    tag = rf"(?is)^(?:(?!{end}).)*?<a\s+{must}([^>]*)>(.*?)</a>"
    attrs = F.regexp_extract("part", tag, 1)
    href = F.trim(F.regexp_extract(attrs, r'(?i)href="([^"]+)"', 1))
    named = F.regexp_extract(attrs, r'(?i)\btitle="([^"]+)"', 1) if relative else F.lit("")
    title = F.coalesce(F.nullif(F.trim(T.decode_entities(named, layout)), F.lit("")), clean(F.regexp_extract("part", tag, 2)))
    raw = clean(F.regexp_extract("part", date, 1))
    day = D.relative_date(raw, F.lit(as_of).cast("date")) if relative else D.named_date(raw)
    cards = parts.select("at", title.alias("title"), F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(origin), href)).otherwise(href).alias("article_url"), day.alias("article_date"))
    return cards.filter("title <> '' AND article_url <> ''")


def news_cards(pages: DataFrame, html: str, layout: str, as_of: str, origin: str = "") -> DataFrame:
    """(title, article_url, article_date), one row for each url of listed_cards(): the
    first on the pages."""
    first = Window.partitionBy("article_url").orderBy("at", "title")
    return listed_cards(pages, html, layout, as_of, origin).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "at")


#: Cards that one listing page gives at most: part of the feature.
CARDS_PER_PAGE = 25
#: Class names of a job card's parts and of a posting's parts, in the order in which
#: they are tried (fixed values).
CARD_TITLE, CARD_COMPANY, CARD_PLACES = "base-search-card__title", "base-search-card__subtitle", ("job-search-card__location", "location")
DESCRIPTIONS = ("description__text", "show-more-less-html__markup", "core-section-container__content", "description")
HIRING_TEAMS = ("posting-extras__hiring-team", "hiring-team", "hirer-card__hirer-information", "base-main-card--link")
MEMBER_NAME = "base-main-card__title"
POSTED_BY = r"(?i)(?:posted by|meet the hiring team)[^<]{0,30}<[^>]+>([A-Z][a-zA-Z\s\-']{2,40})</[^>]+>"


def job_cards(pages: DataFrame, html: str, as_of: str, origin: str = "", company: str = "") -> DataFrame:
    """Job cards of listing pages: title, company, location, url without query and
    age in days; of each page the first 25 in its order. A card is a list item, or
    where a page has none a card's div; one without a title is none."""
    by_item, by_card = F.split(c(html), r"(?i)<li\b[^>]*>"), F.split(c(html), r'(?i)<div[^>]*class="(?:[^"]*\s)?base-card(?:\s[^"]*)?"[^>]*>')
    parts = F.when(F.size(by_item) > 1, by_item).otherwise(by_card)
    of = lambda cls: rf'(?is)<(?:h3|h4|span|a|div)[^>]*class="[^"]*{cls}[^"]*"[^>]*>(.*?)</(?:h3|h4|span|a|div)>'

    def card(part):
        text = lambda p: T.squeeze(T.decode_entities(T.strip_tags(F.regexp_extract(part, p, 1))))
        either = lambda *ps: F.coalesce(*[F.nullif(text(p), F.lit("")) for p in ps])
        link = F.coalesce(*[F.nullif(F.regexp_extract(part, p, 1), F.lit("")) for p in (r'(?is)<a\b[^>]*href="([^"]*/jobs/view/[^"]*)"', r'(?is)<a\b[^>]*href="([^"]+)"')], F.lit(""))
        when = F.try_to_timestamp(F.nullif(F.regexp_extract(part, r'(?is)<time[^>]*datetime="([^"]+)"', 1), F.lit("")))
        age = F.coalesce(F.when(when.isNotNull(), D.age_days(when, F.lit(as_of).cast("timestamp"))), D.days_posted(text(r"(?is)<time[^>]*>(.*?)</time>")))
        return F.struct(
            either(of(CARD_TITLE), r"(?is)<h3[^>]*>(.*?)</h3>").alias("title"), F.coalesce(either(of(CARD_COMPANY), r"(?is)<h4[^>]*>(.*?)</h4>"), F.lit(company)).alias("company"),
            F.coalesce(either(*map(of, CARD_PLACES)), F.lit("")).alias("location"), T.job_url(F.when(F.startswith(link, F.lit("/")), F.concat(F.lit(origin), link)).otherwise(link)).alias("job_url"), age.alias("days_posted"),
        )

    cards = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), card), lambda x: x["title"].isNotNull())
    return pages.select(F.inline(F.slice(cards, 1, CARDS_PER_PAGE)))


def _element(html, cls: str):
    """What stands in the first element of a class, up to the next end of its tag;
    elements of the same tag inside it are not counted."""
    return F.regexp_extract(html, rf'(?is)<([a-z][a-z0-9]*)\b[^>]*class="(?:[^"]*\s)?{cls}(?:\s[^"]*)?"[^>]*>(.*?)</\1>', 2)


def job_description(html):
    """A posting's description: of the places that may hold it the first with 50
    characters or more, else the whole page's text; cut at 2000 characters."""
    text = lambda x: T.squeeze(T.decode_entities(T.strip_tags(x)))
    found = F.filter(F.array(*[text(_element(html, cls)) for cls in DESCRIPTIONS]), lambda t: F.length(t) >= 50)
    rest = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|form|aside)\b[^>]*>.*?</\1>", "")
    return F.substring(F.coalesce(T.nth(found, 1), text(rest)), 1, 2000)


def hiring_name(html):
    """Who hires: a name in the hiring team's card, a poster's name, or one after
    "posted by"; else Unknown."""
    text = lambda x: F.trim(T.decode_entities(T.strip_tags(x)))
    # the team's element may hold others, so its name is looked for behind its beginning
    team = [text(_element(F.regexp_extract(html, rf'(?is)class="(?:[^"]*\s)?{cls}(?:\s[^"]*)?"(.*)', 1), MEMBER_NAME)) for cls in HIRING_TEAMS]
    poster, posted = F.trim(F.regexp_extract(html, r'(?i)data-poster-name="([^"]*)"', 1)), F.trim(F.regexp_extract(html, POSTED_BY, 1))
    return F.coalesce(T.nth(F.filter(F.array(*team, poster, posted), lambda n: F.length(n) > 1), 1), F.lit("Unknown"))


def article_links(html, origin: str, site: str):
    """An array of (title, url) of a listing page: links with a label of ten
    characters or more, label first, then those with the address first; if there
    are none, plain links to the site with a text of twenty. Each url once, at its
    first place."""
    plain = lambda t, more: F.trim(F.replace(F.replace(t, F.lit("&amp;"), F.lit("&")), F.lit("&#039;"), F.lit("'")) if more else F.replace(t, F.lit("&amp;"), F.lit("&")))
    full = lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit(origin), u))

    def links(pattern, title, url, more=True):
        every = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
        return F.zip_with(every(title), every(url), lambda t, u: F.struct(plain(t, more).alias("title"), full(u).alias("url")))

    labelled = F.concat(links(r'<a[^>]+aria-label="([^"]{10,})"[^>]+href="([^"]+)"', 1, 2), links(r'href="([^"]+)"[^>]*aria-label="([^"]{10,})"', 2, 1))
    fallback = links(rf'<a[^>]+href="(https?://{site.replace(".", "[.]")}/[^"]+)"[^>]*>([^<]{{20,}})</a>', 2, 1, more=False)
    once = lambda x: F.filter(x, lambda e, i: F.array_position(F.transform(x, lambda y: y["url"]), e["url"]) == i + 1)
    return F.when(F.size(labelled) > 0, once(labelled)).otherwise(once(fallback))


def _deal(value, party, summary, url):
    return F.struct(value.alias("deal_value"), F.trim(party).alias("counterparty"), summary.alias("deal_summary"), url.alias("source_url"))


def _absolute(href, origin: str):
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(origin), href))


def trade_deal(html, site: str, origin: str, since):
    """The first card of a search page that tells of a deal and is not dated before
    `since`: (deal_value, counterparty, deal_summary, source_url), or null."""
    words, cards, classes = R.TRADE_SITES[site]
    first = lambda x, *ps: F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in ps], F.lit(""))
    title = lambda x: F.replace(F.trim(first(x, r"<h[23][^>]*>([^<]+)</h[23]>", r'class="[^"]*title[^"]*"[^>]*>([^<]+)<')), F.lit("&amp;"), F.lit("&"))

    def fits(x):
        dated = F.coalesce(D.iso_date(F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1)), D.named_date(x))
        return T.has(title(x), words) & F.coalesce(dated >= since, F.lit(True))

    def deal(x):
        t = title(x)
        snippet = F.coalesce(F.nullif(F.trim(F.regexp_extract(x, rf'class="[^"]*(?:{classes})[^"]*"[^>]*>([^<]{{20,300}})', 1)), F.lit("")), t)
        return _deal(F.coalesce(T.amount(t), T.amount(snippet)), F.regexp_extract(t, R.TRADE_PARTY, 1), t, _absolute(F.regexp_extract(x, 'href="([^"]+)"', 1), origin))

    return T.nth(F.transform(F.filter(F.regexp_extract_all(html, F.lit(cards), F.lit(1)), fits), deal), 1)


def investor_deal(html, domain: str, url):
    """Of an investors' page the first link that tells of a deal, else a sum that the
    page names; null for a short page, or one without words of a deal."""
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")
    pattern = r'(?i)<a[^>]+href="([^"]+)"[^>]*>([^<]{15,200})</a>'
    every = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
    links = F.zip_with(every(1), every(2), lambda h, t: F.struct(h.alias("h"), F.trim(F.replace(t, F.lit("&amp;"), F.lit("&"))).alias("t")))
    full = lambda h: F.when(F.startswith(h, F.lit("http")), h).otherwise(F.concat(F.lit(f"https://www.{domain}"), F.when(F.startswith(h, F.lit("/")), "").otherwise("/"), h))
    deal = lambda x: _deal(F.coalesce(T.amount(x["t"]), T.amount(F.substring(text, 1, 2000))), F.regexp_extract(x["t"], R.INVESTOR_PARTY, 1), F.substring(x["t"], 1, 200), full(x["h"]))
    found = T.nth(F.transform(F.filter(links, lambda x: T.has(x["t"], R.INVESTOR_DEAL)), deal), 1)
    value = T.amount(F.substring(text, 1, 3000))
    rest = F.when(value.isNotNull(), _deal(value, F.lit(""), F.lit(""), url))
    return F.when((F.length(html) >= 500) & T.has(text, R.INVESTOR_DEAL), F.coalesce(found, rest))


def search_choice(html, company, origin: str, site: str):
    """The article of a search page to be read: the first whose title has the first
    eight letters of the company, else the first."""
    links = article_links(html, origin, site)
    own = F.filter(links, lambda x: F.contains(F.lower(x["title"]), F.substring(F.lower(company), 1, 8)))
    return F.coalesce(T.nth(own, 1), T.nth(links, 1))


def search_deal(choice, page):
    """What an article (title, url) that was chosen tells: its page's sum, if the
    page was read."""
    text = F.substring(F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), r"\s+", " "), 1, 3000)
    return F.when(choice.isNotNull(), _deal(T.amount(text), F.lit(""), choice["title"], choice["url"]))


def directory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Companies of CSV files with a header: blanks are null, ragged rows are allowed
    (what is missing is null, what is too much is left out), the first of each (name,
    plain url) stays."""
    return checked_directory_csv(spark, path)[0]


def checked_directory_csv(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(companies, quarantine): quarantine has (record, reason) of each line that is
    ragged, though its company is taken, or names no company, so that nothing is lost
    unseen."""
    schema = f"{schemas.DIRECTORY}, _record string"
    # all fields are read, so that a line is found ragged whatever is asked for
    raw = spark.read.schema(schema).option("columnPruning", False).csv(path, header=header, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_record", enforceSchema=True)
    blank = lambda x: F.nullif(F.trim(c(x)), F.lit(""))
    d = raw.select(blank("Name").alias("name"), blank("Domain").alias("domain"), blank("Size").alias("company_size"), blank("Primary Industry").alias("primary_industry"), blank("Type").alias("company_type"), blank("Location").alias("location"), blank("Country").alias("country"), blank("LinkedIn URL").alias("linkedin_url"), "_record")
    line = F.coalesce("_record", F.to_csv(F.struct("name", "primary_industry", "company_size", "company_type", "location", "country", "domain", "linkedin_url")))
    bad = d.select(line.alias("record"), F.when(c("name").isNull(), "no name").when(c("_record").isNotNull(), "ragged").alias("reason")).filter("reason IS NOT NULL")
    d = d.filter("name IS NOT NULL").withColumn("k", F.lower("name")).withColumn("u", T.plain_url(F.coalesce("linkedin_url", F.lit(""))))
    w = Window.partitionBy("k", "u").orderBy(F.col("domain").asc_nulls_last(), F.col("company_size").asc_nulls_last(), "name")
    return d.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "k", "u", "_record"), bad


def contacts_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.CONTACTS).csv(path, header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(*[F.nullif(F.trim(c(x)), F.lit("")).alias(x) for x in raw.columns])
