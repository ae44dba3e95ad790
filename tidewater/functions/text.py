"""Scalar functions over names, titles, urls and filing text: Columns to Columns.

Patterns keep to what both Java and RE2 read; the end of a text is \\z, as Java's $
also matches before a last line feed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import rules as R

_END = r"\z"
#: White space as browsers see it: with the no-break space.
_SPACE = r"[\s\x{a0}]"
#: A word break is one between ASCII characters.
WORD_CHAR = "[A-Za-z0-9_]"


def nth(c, i: int) -> Column:
    """The i-th element of an array, counted from 1; null if there is none."""
    return F.try_element_at(c, F.lit(i))


def has(c: Column, pattern: str, case: bool = False) -> Column:
    """Whether the pattern is found; false for null."""
    return F.coalesce(c.rlike(pattern if case else f"(?i){pattern}"), F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+{_END}", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{_SPACE}+", " "))


def _cut(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def _tail(c: Column) -> Column:
    return strip(_cut(c, rf"[,.\s]+{_END}"))


def clean_name(c: Column, state: bool = True, passes: int = 3, lower: bool = True) -> Column:
    """A company's name without parts in brackets, state and legal suffixes."""
    s = _cut(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)")
    if state:
        s = _cut(s, R.STATE + _END)
    for _ in range(passes):
        s = _cut(s, f"(?i){R.LEGAL}{_END}")
    s = _tail(s)
    return F.lower(s) if lower else s


def news_name(c: Column) -> Column:
    return clean_name(strip(F.coalesce(c, F.lit(""))), state=False, passes=4, lower=False)


def client_name(c: Column) -> Column:
    """Legal then industry suffix, once each; the legal one needs no word break."""
    s = strip(F.lower(F.coalesce(c, F.lit(""))))
    s = _tail(strip(_cut(s, f"(?i){R.CLIENT_LEGAL}{_END}")))
    return _tail(strip(_cut(s, f"(?i){R.CLIENT_INDUSTRY}{_END}")))


def exclusion_name(c: Column) -> Column:
    return F.lower(strip(_cut(c, f"(?i){R.EXCLUSION_SUFFIX}{_END}")))


def short_name(c: Column) -> Column:
    return strip(_cut(c, f"(?i){R.SHORT_SUFFIX}{_END}"))


def similar_name(c: Column) -> Column:
    s = _cut(F.lower(F.coalesce(c, F.lit(""))), "[,.]")
    return squeeze(_cut(s, R.SIMILAR_WORDS))


def names_similar(a: Column, b: Column) -> Column:
    """Equal, or one begins with six or holds eight first letters of the other."""
    one = lambda x, y: (F.length(x) >= 6) & F.startswith(y, F.substring(x, 1, 6)) | (F.length(x) >= 8) & F.contains(y, F.substring(x, 1, 8))
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & ((a == b) | one(a, b) | one(b, a)), F.lit(False))


def words(c: Column, stop: tuple[str, ...] = R.STOP_WORDS) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: (w != "") & ~w.isin(*stop))


def word_key(c: Column) -> Column:
    """The significant words in order, joined; null if there are fewer than two."""
    w = words(c)
    return F.when(F.size(w) >= 2, F.array_join(F.array_sort(w), "|"))


def core_words(c: Column) -> Column:
    return F.slice(words(c, R.SPONSOR_STOP_WORDS), 1, 2)


def first_word(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), "[a-z0-9]+", 0)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def clean_title(c: Column) -> Column:
    return _cut(F.lower(F.coalesce(c, F.lit(""))), r"\([^)]*\)")


def let(x: Column, then) -> Column:
    """then(x), where x is computed once however often it is used: in plain expressions
    each use of x is computed again, in conditions and in lambdas."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def specialties(title: Column, override: Column | None = None) -> Column:
    """All specialties whose words are found, ["Other"] if none; a non-empty
    override array comes first, but not for a blank title."""

    def among(t: Column) -> Column:
        found = F.array(*[F.when(has_any(t, anywhere) | has_whole(t, whole), name) for name, anywhere, whole in R.SPECIALTIES])
        out = let(F.filter(found, lambda x: x.isNotNull()), lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("Other"))))
        if override is not None:
            out = F.when(F.size(override) > 0, override).otherwise(out)
        return F.when(strip(t) == "", F.array(F.lit("Other"))).otherwise(out)

    return let(clean_title(title), among)


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def has_whole(c: Column, parts: tuple[str, ...]) -> Column:
    return has(c, rf"(^|[^a-z0-9])({'|'.join(map(re.escape, parts))})([^a-z0-9]|\z)") if parts else F.lit(False)


def role_pattern(strict: bool = False) -> str:
    """Roles found anywhere (abbreviations too, unless strict), whole abbreviations,
    and parts of roles."""
    names = [re.escape(r).replace(r"\ ", " ").replace(r"\-", "-").replace(r"\/", "/") for r in R.ROLES if not (strict and r in R.ROLE_ABBREVIATIONS)]
    return "|".join([*names, *(rf"\b{a}\b" for a in R.ROLE_ABBREVIATIONS), *R.ROLE_PARTS])


def _numeric(c: Column, pattern: str, base: int) -> Column:
    """Numeric entities as their characters: the text between them and the
    characters are put together again."""
    gaps, codes = F.split(c, pattern.replace("(", "(?:"), -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    point = (lambda n: F.conv(n, 16, 10).cast("int")) if base == 16 else (lambda n: n.cast("int"))
    chars = F.transform(codes, lambda n: F.decode(F.unhex(F.lpad(F.hex(point(n)), 8, "0")), "UTF-32"))
    return F.array_join(F.zip_with(gaps, chars, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def decode_entities(c: Column, table: str = "filing") -> Column:
    """Entities of a source's table in its order, then numeric ones."""
    for a, b in R.ENTITIES[table]:
        c = F.replace(c, F.lit(a), F.lit(b))
    if table == "relative":
        c = F.regexp_replace(c, "\u00ad|&#0*173;", "")
    c = F.when(F.contains(c, F.lit("&#")), _numeric(c, "&#([0-9]{1,6});", 10)).otherwise(c)
    return F.when(F.contains(c, F.lit("&#x")), _numeric(c, "&#x([0-9a-fA-F]{1,5});", 16)).otherwise(c)


def strip_tags(c: Column, to: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]*>", to)


def headline_deal(c: Column) -> Column:
    out = F.when(F.lit(False), None)
    for name, pattern in R.HEADLINE_DEALS:
        out = out.when(F.lower(c).rlike(pattern), name)
    return out


def headline_company(c: Column) -> Column:
    """Whom a headline is about: four forms, else its first three words."""
    t = F.replace(F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&#039;"), F.lit("'")), F.lit("&quot;"), F.lit('"'))
    # an array of one text: it has a name and is made once
    found = lambda x: F.filter(F.transform(F.array(*[F.regexp_extract(x, p, 1) for p in R.HEADLINE_FORMS]), strip), lambda n: n != "")
    return nth(F.transform(F.array(t), lambda x: F.coalesce(nth(found(x), 1), F.array_join(F.slice(F.split(x, r"\s+"), 1, 3), " "))), 1)


def needed_words(pattern: str) -> tuple[str, ...]:
    """Of each alternative of a pattern its longest run of plain letters, blanks and
    hyphens: a text that the pattern fits has one of them. None (empty) if an alternative
    has no run of four."""
    out, runs, run, depth, i = [], [], "", 0, 0
    text = pattern + "|"
    while i < len(text):
        ch, step = text[i], 1
        if ch == "\\":
            step = 2
            plain = text[i + 1] if not text[i + 1].isalnum() else None
        elif ch == "[":
            step, plain = text.index("]", i + 2) - i + 1, None
        else:
            plain = ch if ch.isalpha() or ch in " -" else None
        nxt = text[i + step : i + step + 1]
        if depth == 0 and plain is not None and nxt not in ("?", "*", "{"):
            run += plain
        else:
            runs.append(run)
            run = ""
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "|" and depth == 0:
            best = max(runs, key=len, default="")
            if len(best) < 4:
                return ()
            out.append(best)
            runs = []
        i += step
    return tuple(out)


def transaction_kind(c: Column, rules: tuple = R.TRANSACTIONS, gated: bool = True) -> Column:
    """The kind whose rules weigh most; of equals the first; acquisition if none.
    The text is put in lower case once, so that the patterns need not tell cases, and
    is searched once for the words that the patterns need: a pattern runs only on texts
    that have one of its words (always, if not gated)."""
    compound = has(c, R.COMPOUND, case=True)
    names = F.array(*[F.lit(n) for n, _ in rules])
    lower = lambda p: p.replace("[A-Z]", "[a-z]")
    needs_of = {p: needed_words(lower(p)) if gated else () for _, each in rules for _, patterns, _ in each for p in patterns}
    words = sorted({w for ws in needs_of.values() for w in ws})

    def pick(t, named, there):
        totals = []
        for _, each in rules:
            total = F.lit(0)
            for weight, patterns, needs in each:
                ok = F.lit(True)
                for p in patterns:
                    if needs_of[p]:
                        ok = ok & reduce(Column.__or__, [there[f"w{words.index(w)}"] for w in needs_of[p]])
                for p in patterns:
                    ok = ok & t.rlike(lower(p))
                if needs is not None:
                    ok = ok & (named if needs else ~named)
                total = total + F.when(ok, weight).otherwise(0)
            totals.append(total)
        best = lambda x: F.when(F.array_max(x) == 0, "acquisition").otherwise(F.get(names, (F.array_position(x, F.array_max(x)) - 1).cast("int")))
        return nth(F.transform(F.array(F.array(*totals)), best), 1)

    # an array of one: what is in it has a name and is made once
    t = F.lower(c)
    there = F.struct(F.lit(True).alias("any"), *[F.contains(t, F.lit(w)).alias(f"w{i}") for i, w in enumerate(words)])
    kind = F.transform(F.array(F.struct(t.alias("t"), compound.alias("named"), there.alias("there"))), lambda x: pick(x["t"], x["named"], x["there"]))
    return F.when(F.coalesce(c, F.lit("")) == "", "acquisition").otherwise(nth(kind, 1))


def agreement_kind(c: Column) -> Column:
    t = F.lower(c)
    out = F.when(F.coalesce(c, F.lit("")) == "", "Other")
    for name, some, none in R.AGREEMENTS:
        out = out.when(has_any(t, some) & ~has_any(t, none), name)
    return out.otherwise("Other")


def party(c: Column, filer: Column, patterns: tuple[str, ...], least: int = 3, most: int = 80, cut: bool = False) -> Column:
    """The first pattern's name that is long enough and not the filer's own; "" if
    there is none. With cut, what follows a legal suffix goes and longer names
    don't count; else names are cut to `most`."""
    own = F.substring(F.lower(filer), 1, 10)
    found = F.array(*[F.regexp_extract(c, p, 1) for p in patterns])
    plain = lambda n: strip(F.regexp_replace(squeeze(n), r"\s*(Inc\.|Corp\.|LLC|Ltd\.).*\z", "$1")) if cut else F.substring(squeeze(n), 1, most)
    ok = lambda n: (F.length(n) >= least) & (F.length(n) <= most) & ~F.startswith(F.lower(n), own)
    return F.coalesce(nth(F.filter(F.transform(found, plain), ok), 1), F.lit(""))


def asset(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in R.ASSET])


def amount(c: Column) -> Column:
    """The first sum of money: $1.2B or $45M."""
    p = r"(?i)\$\s*(\d[\d.,]*)\s*(million|billion|M|B)\b"
    unit = F.lower(F.regexp_extract(c, p, 2))
    return F.when(unit != "", F.concat(F.lit("$"), F.replace(F.regexp_extract(c, p, 1), F.lit(","), F.lit("")), F.when(unit.isin("billion", "b"), "B").otherwise("M")))


def amount_long(c: Column) -> Column:
    """Any sum in billions, else one in millions: $1.2 billion."""
    out = [F.when(F.regexp_extract(c, rf"(?i)\$\s*(\d[\d.,]*)\s*{u}\b", 1) != "", F.concat(F.lit("$"), F.replace(F.regexp_extract(c, rf"(?i)\$\s*(\d[\d.,]*)\s*{u}\b", 1), F.lit(","), F.lit("")), F.lit(f" {n}"))) for n, u in (("billion", "(?:billion|B)"), ("million", "(?:million|M)"))]
    return F.coalesce(*out)


#: Sums in words, tried in turn, each with its unit or where it stands (fixed values).
SUMS = (
    (r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*billion", "billion"), (r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*million", "million"), (r"(?i)([\d,]+(?:\.\d+)?)\s*billion\s+(?:USD|dollars)", "billion"),
    (r"(?i)([\d,]+(?:\.\d+)?)\s*million\s+(?:USD|dollars)", "million"), (r"(?i)approximately\s+\$\s*([\d,]+(?:\.\d+)?)\s*(billion|million)", None),
    (r"(?i)aggregate\s+(?:consideration|value|purchase price)\s+of\s+\$\s*([\d,]+(?:\.\d+)?)\s*(billion|million)", None),
)


def amount_words(c: Column) -> Column:
    """A sum as "$45 million": any in billions of dollars before any in millions."""
    one = lambda p, unit: F.when(c.rlike(p), F.concat(F.lit("$"), F.replace(F.regexp_extract(c, p, 1), F.lit(","), F.lit("")), F.lit(" "), F.lit(unit) if unit else F.lower(F.regexp_extract(c, p, 2))))
    return F.coalesce(*[one(p, unit) for p, unit in SUMS])


def with_deal(df: DataFrame, text: str, filer: str, backfill: bool = False) -> DataFrame:
    """df with what a filing says about a deal: transaction_type, acquirer_name,
    acquired_name, acquired_asset, deal_value, deal_summary, snippet; who is who
    depends on the type. Step by step, so that no step's patterns run twice.
    With backfill, by the rules of the second pass: fewer rules of product deals,
    fewer sellers, sums in words and no other counterparty."""
    c, f = F.col(text), F.col(filer)
    none = lambda x: F.nullif(x, F.lit(""))
    col = F.col
    df = df.withColumn("transaction_type", transaction_kind(c, R.TRANSACTIONS_BACKFILL if backfill else R.TRANSACTIONS)).withColumn("deal_value", amount_words(c) if backfill else amount(c))
    kind = col("transaction_type")
    df = df.withColumn("__parent", F.when(kind == "merger", party(c, f, R.PARENT)).otherwise(""))
    df = df.withColumn("__target", F.when(kind.isin("merger", "acquisition", "partnership") & (col("__parent") == ""), party(c, f, R.TARGET, cut=True)).otherwise(""))
    df = df.withColumn("__seller", F.when((kind == "product_acquisition") | (kind == "partnership") & (col("__target") == ""), party(c, f, R.SELLER_BACKFILL if backfill else R.SELLER)).otherwise(""))
    df = df.withColumn("acquirer_name", F.coalesce(none(col("__parent")), f))
    df = df.withColumn("__acquired", F.when(col("__parent") != "", f).otherwise(F.coalesce(none(col("__target")), col("__seller"))))
    df = df.withColumn("acquired_name", F.when(kind == "ipo", "").when(col("__acquired") != "", col("__acquired")).otherwise(F.lit("") if backfill else party(F.substring(c, 1, 2000), f, R.COUNTERPARTY)))
    df = df.withColumn("acquired_asset", F.when(kind != "ipo", asset(c)))
    with_ = lambda word, x: F.coalesce(F.concat(F.lit(word), none(x)), F.lit(""))
    value, other, what = col("deal_value"), col("acquired_name"), col("acquired_asset")
    summary = (
        F.when(kind == "ipo", F.concat(f, F.lit(" announced a public offering"), with_(" valued at ", value), F.lit(".")))
        .when(col("__parent") != "", F.concat(col("__parent"), F.lit(" is acquiring "), f, with_(" for ", value), F.lit(".")))
        .when(kind == "merger", F.concat(f, F.lit(" announced a merger"), with_(" with ", other), with_(" valued at ", value), F.lit(".")))
        .when(kind == "product_acquisition", F.concat(f, F.lit(" is acquiring "), F.coalesce(what, F.lit("product rights")), with_(" from ", other), with_(" for ", value), F.lit(".")))
        .when(kind == "partnership", F.concat(f, F.lit(" announced a licensing/collaboration agreement"), with_(" with ", other), with_(" valued at ", value), F.lit(".")))
        .otherwise(F.concat(f, F.lit(" is acquiring "), F.coalesce(none(other), F.lit("a company")), with_(" for ", value), F.lit(".")))
    )
    return df.withColumn("deal_summary", summary).withColumn("snippet", F.when(F.length(strip(c)) > 50, F.substring(strip(c), 1, 500))).drop("__parent", "__target", "__seller", "__acquired")


def display_name(c: Column) -> Column:
    """(name, ticker) of a filer's display name: "Acme Inc (ACME) (CIK 1)"."""
    ticker = F.nullif(F.regexp_extract(c, r"\(([A-Z]{1,5})\)", 1), F.lit(""))
    return F.struct(strip(F.substring_index(c, "(", 1)).alias("name"), ticker.alias("ticker"))


def filing_url(cik: Column, accession: Column, base: str = "https://filings.example/data") -> Column:
    return F.concat(F.lit(base + "/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit(".txt"))


def job_url(c: Column) -> Column:
    """Without its query; the fragment stays."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\?[^#]*", "")


def plain_url(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"/+\z", "")


def job_id(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"/jobs/view/(?:[^/?]*-)?(\d+)", r"currentJobId=(\d+)", r"(\d{8,})")])


def email_domain(emails: Column) -> Column:
    """Domain of the first address that is not at a general provider."""
    domains = F.transform(emails, lambda e: F.lower(strip(F.when(F.contains(e, F.lit("@")), F.regexp_extract(e, "@(.*)", 1)))))
    return nth(F.filter(domains, lambda d: d.isNotNull() & (d != "") & ~d.isin(*R.GENERIC_DOMAINS)), 1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def headline_role(c: Column) -> Column:
    """(role, company) of "role at company": the first and what follows the last."""
    at = F.instr(F.lower(c), " at ")
    role = F.when(at > 0, strip(F.substr(c, F.lit(1), at - 1))).otherwise(strip(c))
    company = F.when(at > 0, strip(F.substr(c, F.length(c) - F.length(F.substring_index(F.lower(c), " at ", -1)) + 1)))
    return F.struct(role.alias("role"), company.alias("company"))


def without_name(c: Column, name: Column) -> Column:
    """The text without a name, whatever its case, spaces squeezed."""
    return squeeze(F.regexp_replace(c, F.concat(F.lit(r"(?i)\Q"), name, F.lit(r"\E")), F.lit("")))


def substantive(c: Column) -> Column:
    """Twenty characters at least, and eighty or a word that filings use."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return (F.length(t) >= 20) & ((F.length(t) >= 80) | has(t, rf"(?<!{WORD_CHAR})({'|'.join(R.FILING_WORDS)})(?!{WORD_CHAR})"))


def document_body(c: Column) -> Column:
    """Of a filing of several documents, the text of the first that is an 8-K."""
    docs = F.regexp_extract_all(c, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    hit = F.filter(docs, lambda d: F.upper(strip(F.regexp_extract(d, r"(?i)<TYPE>\s*([^\n]*)", 1))).isin("8-K", "8-K/A"))
    return F.nullif(nth(F.transform(F.filter(hit, lambda d: F.regexp_like(d, F.lit("(?is)<TEXT>.*?</TEXT>"))), lambda d: F.regexp_extract(d, r"(?is)<TEXT>(.*?)</TEXT>", 1)), 1), F.lit(""))


def item_summary(html: Column) -> Column:
    """First substantive paragraph after the heading of Item 1.01, else the first
    telling sentence before the next item."""
    head = r"(?is)Item[\s\x{a0}&#;0-9]*1\.01.*?Entry\s+into\s+a\s+Material\s+Definitive\s+Agreement"
    after = F.when(F.regexp_like(html, F.lit(head)), nth(F.split(html, head, 2), 2))
    ps = F.transform(F.regexp_extract_all(after, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: squeeze(decode_entities(strip_tags(p))))
    first = F.substring(nth(F.filter(ps, substantive), 1), 1, 5000)
    section = nth(F.split(after, r"(?i)Item[\s\x{a0}&#;0-9]*[0-9]+\.[0-9]+", 2), 1)
    plain = squeeze(decode_entities(strip_tags(section)))
    sentence = nth(F.filter(F.split(plain, r"(?<=\.)\s+"), lambda s: (F.length(strip(s)) >= 40) & has(s, R.TELLING_WORDS)), 1)
    rest = strip(F.substring(F.substr(plain, F.position(sentence, plain)), 1, 5000))
    return F.coalesce(first, F.when(sentence.isNotNull(), rest))


#: Text before a dot in a profile that is a date or a length, not a company (fixed value).
_SKIP = r"(?i)^\d{4}\z|present|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\d+\s*(yr|mo|year|month)"


def profile_company(html: Column) -> Column:
    """Of a profile's paragraphs with a middle dot, the first part that can be a
    company's name."""
    ps = F.transform(F.regexp_extract_all(html, F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: strip(strip_tags(p)))
    heads = F.transform(F.filter(ps, lambda p: F.contains(p, F.lit(" · "))), lambda p: strip(F.substring_index(p, " · ", 1)))
    return nth(F.filter(heads, lambda h: F.length(h).between(2, 50) & ~h.rlike(_SKIP)), 1)


def employee_count(html: Column) -> Column:
    """Lower bound of a company page's size range."""
    p = r"""(?s)jobSearchUrl.{0,200}?employeeCountRange.{0,50}?start(?:&quot;|")\s*(?::|&#58;)\s*(\d+)"""
    return F.regexp_extract(html, p, 1).try_cast("int")


def page_company(html: Column) -> Column:
    """A company page's name: of its title before a bar, else the first plain name
    of its data."""
    title = strip(F.regexp_extract(html, r"<title>\s*(?:\(\d+\)\s*)?([^|<]{2,80}?)\s*(?::\s*[^|<]{0,60})?\s*\|", 1))
    names = F.concat(F.regexp_extract_all(html, F.lit("&quot;name&quot;:&quot;([^&]{2,100})&quot;"), F.lit(1)), F.regexp_extract_all(html, F.lit(r'"name"\s*:\s*"([^"]{2,100})"'), F.lit(1)))
    plain = F.filter(F.transform(names, strip), lambda n: ~F.contains(n, F.lit(".")) & ~F.contains(F.lower(n), F.lit("linkedin")))
    return F.coalesce(F.when((F.length(title) > 1) & (F.lower(title) != "linkedin"), title), nth(plain, 1))


def significant_word(c: Column) -> Column:
    """The first word of two letters or more that is no stop word, else the first."""
    w = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda x: x != "")
    return F.coalesce(nth(F.filter(w, lambda x: (F.length(x) > 1) & ~x.isin(*R.PAGE_STOP_WORDS)), 1), nth(w, 1), F.lit(""))


def same_company(name: Column, page: Column) -> Column:
    """A page that names no company, or one with the same first significant word."""
    a, b = significant_word(name), F.coalesce(significant_word(page), F.lit(""))
    return (a == "") | (b == "") | (a == b)


def has_phrases(c: Column, *phrases: str) -> Column:
    """All phrases are in the text, as whole words in any case."""
    return reduce(Column.__and__, [c.rlike(r"(?i)(?<![\p{Alnum}])" + re.escape(p).replace("\\ ", r"\s+") + r"(?![\p{Alnum}])") for p in phrases])


def display_case(c: Column) -> Column:
    """A name without the places after its legal suffix, words capitalised; short
    words in capitals that are no legal suffix stay."""
    n = strip(F.coalesce(c, F.lit("")))
    n = strip(F.regexp_replace(n, R.PLACE_AFTER_SUFFIX, "$1"))
    n = F.regexp_replace(n, r",\s*\z", "")
    keep = lambda w: (F.length(w) <= 3) & (w == F.upper(w)) & ~F.upper(w).isin(*R.CASED_SUFFIXES)
    words_, gaps = F.regexp_extract_all(n, F.lit("[A-Za-z]+"), F.lit(0)), F.split(n, "[A-Za-z]+", -1)
    cased = F.transform(words_, lambda w: F.when(keep(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))))
    return F.array_join(F.zip_with(gaps, cased, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def post_deal(html: Column) -> Column:
    """Kind of deal of a posts page: ipo, acquisition, merger, partnership, in this
    order."""
    t = F.lower(html)
    out = F.when(F.lit(False), None)
    for name, pattern in R.POST_DEALS:
        out = out.when(t.rlike(pattern), name)
    return out


def lead_specialty(title: Column, specialty: Column) -> Column:
    """Null for a blocked title (human resources), else the specialties, and
    Talent Acquisition where the title says so."""

    def among(t: Column, own: Column) -> Column:
        talent = F.contains(t, F.lit("talent acquisition"))
        base = F.when((F.size(own) == 1) & (nth(own, 1) == "Other"), F.slice(own, 1, 0)).otherwise(own)
        return F.when(F.contains(t, F.lit("human resources")) & ~talent, None).when(talent, F.array_union(base, F.array(F.lit("Talent Acquisition")))).otherwise(own)

    return let(clean_title(title), lambda t: let(specialty, lambda own: among(t, own)))


def company_url(c: Column) -> Column:
    """Whether a url is a company's page, not one below it."""
    return has(c, r"^https://www\.linkedin\.com/company/[^/?#]+/?\z")
