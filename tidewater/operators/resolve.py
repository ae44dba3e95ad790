"""Entity resolution: ordered layers, each a join on a key that is unique on the
build side, so that rows don't multiply; the first layer that hits wins.

Declared order: of equal keys the largest company, then the least name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.functions.scores import client_boost, parse_size
from tidewater.operators.lookup import lookup, once, prefixes_in


def largest(directory: DataFrame, *by: str) -> DataFrame:
    """(by, __s): the largest size of each name. A directory in few files is dealt out by
    it, before its names are cleaned; the count of sizes alone needs no sort."""
    return directory.groupBy(*by).agg(F.max(parse_size(F.col("size"))).alias("__s"))


def best_by(sized: DataFrame, key: str, alias: str) -> DataFrame:
    """(alias, alias_name): the best name of each key, of sized ones (largest()); no null
    or empty key. A partial aggregate, so that a common key is no hot task."""
    d = sized.withColumnRenamed(key, alias).filter(F.col(alias).isNotNull() & (F.col(alias) != ""))
    return d.groupBy(alias).agg(F.min(F.struct(-F.col("__s"), "name")).alias("__b")).select(alias, F.col("__b.name").alias(f"{alias}_name"))


def match_key(name: Column) -> Column:
    """What two names have in common if match_company() matches them without an alternate
    name: the key of significant words, or where there is none the cleaned name."""
    cleaned = T.clean_name(name)
    return F.coalesce(F.nullif(T.word_key(cleaned), F.lit("")), cleaned, F.lit(""))


def match_company(names: DataFrame, directory: DataFrame, name: str = "company_name", alternates: DataFrame | None = None) -> DataFrame:
    """names with matched_name and matched_via: an alternate name (given and not
    no_match), the cleaned name, or the key of significant words."""
    df = once(once(names, __e=T.clean_name(F.col(name))), __k=T.word_key(F.col("__e")))
    sized = once(once(largest(directory, "name"), __e=T.clean_name(F.col("name"))), __k=T.word_key(F.col("__e")))
    exact, keyed = best_by(sized, "__e", "__e"), best_by(sized, "__k", "__k")
    df = lookup(lookup(df, exact, ["__e"]), keyed, ["__k"])
    layers = [("exact_name", "__e_name"), ("keyword", "__k_name")]
    if alternates is not None:
        alt = alternates.groupBy(F.lower(F.trim("alternate_name")).alias("__a")).agg(F.min("directory_name").alias("__a_name"))
        df = lookup(df.withColumn("__a", F.lower(F.trim(F.col(name)))), alt, ["__a"])
        layers.insert(0, ("alternate_name", "__a_name"))
    via = F.when(F.lit(False), None)
    for label, c in layers:
        via = via.when(F.col(c).isNotNull(), label)
    return df.select(*[names[c] for c in names.columns], F.coalesce(*[F.col(c) for _, c in layers]).alias("matched_name"), via.alias("matched_via"))


def match_sponsor(sponsors: DataFrame, directory: DataFrame) -> DataFrame:
    """sponsors (sponsor, emails) with matched_name and matched_via: e-mail domain,
    cleaned name, two core words as a prefix, then one; else the sponsor itself
    as no_match.

    Of a domain's largest companies, one with a word of three letters or more
    inside the domain comes first. All layers are lookups of equal keys: for the
    prefixes, entries are filed under each prefix as long as some sponsor's words."""
    df = once(once(sponsors, __d=T.email_domain(F.col("emails")), __e=T.clean_name(F.col("sponsor"), state=False)), __core=T.core_words(F.col("__e")))
    df = once(df, __w=T.nth(F.col("__core"), 1), __n=F.size("__core"), __p=F.array_join("__core", " ")).drop("__core")
    # a single short word must be the whole name
    short = (F.col("__n") == 1) & (F.length("__w") <= 4)
    df = df.withColumn("__p", F.when(~short, F.col("__p"))).withColumn("__x", F.when(short, F.col("__w"))).withColumn("__w", F.when(~short, F.col("__w")))
    d = once(largest(directory, "name", "domain"), __d=F.lower(F.trim("domain")), __e=T.clean_name(F.col("name"), state=False)).filter("__e <> ''")
    inside = F.exists(T.words(F.col("__e"), ()), lambda w: (F.length(w) >= 3) & F.contains(F.col("__d"), w))
    by_domain = d.filter("__d <> ''").groupBy("__d").agg(F.min(F.struct(-F.col("__s"), ~inside, "name")).alias("b")).select("__d", F.col("b.name").alias("__n1"))
    by_name = d.groupBy("__e").agg(F.min(F.struct(-F.col("__s"), "name")).alias("b")).select("__e", F.col("b.name").alias("__n2"))
    entries = once(d, __w=T.nth(T.words(F.col("__e"), R.SPONSOR_STOP_WORDS), 1)).select("__w", F.col("__e").alias("__c"), "__s", "name").filter("__w IS NOT NULL AND startswith(__c, __w)")
    best = F.min(F.struct(-F.col("__s"), "name")).alias("b")
    whole = entries.filter("__c = __w").groupBy(F.col("__w").alias("__x")).agg(best).select("__x", F.col("b.name").alias("__n3"))
    # an entry that begins with both core words counts before one with the first only
    filed = prefixes_in(entries, "__c", df.select("__w", "__p").filter("__p <> ''").distinct(), "__p", (F.col("__w"), F.col("__w")))
    both = filed.groupBy("__w", F.col("__prefix").alias("__p")).agg(best).select("__w", "__p", F.col("b.name").alias("__n4"))
    one = entries.groupBy("__w").agg(best).select("__w", F.col("b.name").alias("__n5"))
    out = lookup(lookup(df, by_domain, ["__d"]), by_name, ["__e"])
    out = lookup(lookup(lookup(out, whole, ["__x"]), both, ["__w", "__p"]), one, ["__w"])
    word = F.coalesce("__n3", "__n4", "__n5")
    via = F.when(F.col("__n1").isNotNull(), "email_domain").when(F.col("__n2").isNotNull(), "exact_name").when(word.isNotNull(), "keyword").otherwise("no_match")
    return out.select(*[sponsors[c] for c in sponsors.columns], F.coalesce("__n1", "__n2", word, F.col("sponsor")).alias("matched_name"), via.alias("matched_via"))


#: From a name's first letter or digit on; what stands before is tested when it is found.
def _core(x: Column) -> Column:
    return F.regexp_replace(x, "^[^a-z0-9]+", "")


def title_spans(titles: DataFrame, names: DataFrame) -> DataFrame:
    """The span index: (__id, __t, __at, __core) for each stretch of a title (__t, its
    words with their places in __words) that begins with a word, ends before something
    else than a letter or digit, and is as long as a name (__w, __core) that begins with
    that word. A word has as many stretches as there are such lengths, however many
    names there are."""
    sizes = names.groupBy("__w").agg(F.collect_set(F.length("__core")).alias("__sizes"))
    found = lookup(titles.select("__id", "__t", F.explode("__words").alias("__o")).select("__id", "__t", F.col("__o.word").alias("__w"), F.col("__o.place").alias("__at")), sizes, ["__w"])
    fits = F.filter("__sizes", lambda n: ~F.substr("__t", F.col("__at") + n, F.lit(1)).rlike("[a-z0-9]") & (F.col("__at") + n - 1 <= F.length("__t")))
    return found.withColumn("__n", F.explode(fits)).select("__id", "__t", "__at", "__w", F.substr("__t", "__at", "__n").alias("__core"))


def match_titles(titles: DataFrame, directory: DataFrame, alternates: DataFrame, key: str = "id", title: str = "title") -> DataFrame:
    """(key, matched_names): directory names that a title starts with, longest
    first, then those of alternate names anywhere in it, in order of the title's
    words; null if none. Titles are exploded into stretches of words that are as long
    as some name, which are joined to whole names: what comes out is matches, and names
    whose first place in the title breaks a word."""
    t = once(titles.select(F.col(key).alias("__id"), F.col(title).alias("__title")), __t=F.lower("__title")).filter("__t <> ''")
    # each run of letters and digits with its place
    letter = lambda x: x.between("0", "9") | x.between("a", "z")
    t = once(t.select("__id", "__t"), __c=F.split("__t", F.lit("")))
    begins = F.filter(F.sequence(F.lit(1), F.size("__c")), lambda i: letter(F.get("__c", i - 1)) & ~F.coalesce(letter(F.get("__c", i - 2)), F.lit(False)))
    t = once(t, __words=F.zip_with(F.regexp_extract_all("__t", F.lit("[a-z0-9]+"), F.lit(0)), begins, lambda w, i: F.struct(w.alias("word"), i.alias("place")))).drop("__c")
    names = directory.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    one = once(names, __x=F.lower(T.news_name(F.col("name")))).filter((F.length("__x") >= 3) & ~F.col("__x").isin(*R.GENERIC_TERMS))
    one = once(one, __w=T.first_word(F.col("__x")), __core=_core(F.col("__x"))).filter("__w <> ''")
    starts = title_spans(t.withColumn("__words", F.slice("__words", 1, 1)), one).join(one, ["__w", "__core"]).filter(F.startswith("__t", "__x"))
    starts = starts.select("__id", F.lit(1).alias("layer"), F.lit(0).alias("at"), (-F.length("__x")).alias("long"), "name")
    two = alternates.select(F.lower(F.trim("alternate_name")).alias("__x"), F.trim("directory_name").alias("name")).filter((F.length("__x") >= 3) & (F.col("name") != "")).distinct()
    two = once(two, __w=T.first_word(F.col("__x")), __core=_core(F.col("__x"))).filter("__w <> ''")
    # only the first place is tested for word breaks
    place = F.expr("locate(__x, __t)")
    before, after = F.substr("__t", F.greatest(place - 1, F.lit(1)), F.lit(1)), F.substr("__t", place + F.length("__x"), F.lit(1))
    anywhere = title_spans(t, two).join(two, ["__w", "__core"]).filter((place > 0) & ~((place > 1) & before.rlike("[a-z0-9]")) & ~after.rlike("[a-z0-9]"))
    # once for each title and name, in order of the first places of the names' first words
    at = F.regexp_instr("__t", F.concat(F.lit("(?<![a-z0-9])"), "__w", F.lit("(?![a-z0-9])")))
    anywhere = anywhere.select("__id", F.lit(2).alias("layer"), at.alias("at"), (-F.length("__x")).alias("long"), "name")
    every = starts.union(anywhere)
    first = every.groupBy("__id", F.lower("name").alias("__l")).agg(F.min(F.struct("layer", "at", "long", "name")).alias("b"))
    found = first.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["name"]).alias("matched_names"))
    return titles.select(F.col(key)).join(found.withColumnRenamed("__id", key), key, "left")


def past_clients(clients: DataFrame) -> DataFrame:
    """Active clients with what they are matched by. A list that is kept by hand."""
    c = clients.filter("is_active").select("name", "rank", F.lower(F.trim("name")).alias("c_exact"), T.client_name(F.col("name")).alias("c_plain"))
    return c.withColumn("c_words", F.filter(F.split("c_plain", r"\s+"), lambda w: w != "")).withColumn("boost", client_boost(F.col("rank")))


def _words_in(kw: Column, words: Column, plain: Column) -> Column:
    """All of kw in the other name: short ones as whole words, others as listed."""
    short = lambda k: F.regexp_like(plain, F.concat(F.lit(r"\b\Q"), k, F.lit(r"\E\b")))
    return (F.size(kw) > 0) & (F.size(words) > 0) & F.forall(kw, lambda k: F.when(F.length(k) <= 4, short(k)).otherwise(F.array_contains(words, k)))


def _terms(words: Column, plain: Column, whole: bool) -> Column:
    """What a name is filed under. A long word is filed as it is. A short one may
    stand between any marks of the other name: it is filed under its first run of
    letters and digits, and the other name under all of its runs."""
    runs = lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    tag = lambda t: lambda x: F.concat(F.lit(t), x)
    if whole:
        return F.array_distinct(F.concat(F.transform(words, tag("w")), F.transform(runs(plain), tag("r"))))
    return F.array_distinct(F.transform(words, lambda k: F.when(F.length(k) > 4, F.concat(F.lit("w"), k)).when(F.size(runs(k)) > 0, F.concat(F.lit("r"), F.get(runs(k), F.lit(0)))).otherwise("-")))


def _all_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): numbers of rows (n, plain, words) where all of left's words are in
    right's name. Joined on the rarest of left's terms among right's names; names
    without such a term (marks only) are tested against those that have marks."""
    filed = right.select("n", F.explode(_terms(F.col("words"), F.col("plain"), True)).alias("term"))
    marks = right.filter(F.exists("words", lambda w: ~w.rlike("[A-Za-z0-9_]"))).select("n", F.lit("-").alias("term"))
    filed = filed.union(marks).distinct()
    common = filed.groupBy("term").agg(F.count(F.lit(1)).alias("names"))
    asked = left.select(F.col("n").alias("l"), F.explode(_terms(F.col("words"), F.col("plain"), False)).alias("term"))
    asked = asked.join(common, "term", "left").groupBy("l").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "term")).alias("t")).filter("t.names > 0").select("l", F.col("t.term").alias("term"))
    pairs = asked.join(filed.withColumnRenamed("n", "r"), "term").select("l", "r")
    x = left.select(F.col("n").alias("l"), F.col("words").alias("kw"))
    y = right.select(F.col("n").alias("r"), "words", "plain")
    return pairs.join(x, "l").join(y, "r").filter(_words_in(F.col("kw"), F.col("words"), F.col("plain"))).select("l", "r")


def match_clients(names: DataFrame, clients: DataFrame, name: str = "name") -> DataFrame:
    """(name, client, rank, boost): of each distinct name the first layer's client
    of the least rank: equal, equal without suffixes, all words of one in the
    other.

    All layers are joins on equal keys: the third on the rarest word, with a test
    of the rest."""
    c = past_clients(clients)
    n = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    n = n.withColumn("n_exact", F.lower(F.trim("name"))).withColumn("n_plain", T.client_name(F.col("name"))).withColumn("n_words", F.filter(F.split("n_plain", r"\s+"), lambda w: w != ""))
    pick = lambda key: c.filter(f"{key} <> ''").groupBy(key).agg(F.min(F.struct("rank", F.col("name").alias("client"), "boost")).alias("b"))
    a, b = pick("c_exact").withColumnsRenamed({"c_exact": "n_exact", "b": "b1"}), pick("c_plain").withColumnsRenamed({"c_plain": "n_plain", "b": "b2"})
    both = n.join(a, "n_exact", "left").join(b, "n_plain", "left").withColumn("b", F.coalesce("b1", "b2"))
    left = both.filter("b IS NULL AND n_plain <> ''").select(F.col("name").alias("n"), F.col("n_plain").alias("plain"), F.col("n_words").alias("words"))
    # clients that are alike in all but rank and name are one to the third layer
    best = c.filter("c_plain <> ''").groupBy("c_plain").agg(F.min(F.struct("rank", F.col("name").alias("client"), "boost")).alias("b"), F.first("c_words").alias("words"))
    right = best.select(F.col("c_plain").alias("n"), F.col("c_plain").alias("plain"), "words")
    pairs = _all_words(right, left).select(F.col("r").alias("name"), F.col("l").alias("c_plain")).union(_all_words(left, right).select(F.col("l"), F.col("r")))
    third = pairs.join(best.select("c_plain", "b"), "c_plain").groupBy("name").agg(F.min("b").alias("b"))
    return both.filter("b IS NOT NULL").select("name", "b").union(third).select("name", "b.client", "b.rank", "b.boost")


def excluded(names: DataFrame, excluded_names: DataFrame, name: str = "name", exempt: DataFrame | None = None) -> DataFrame:
    """Distinct names of which an excluded one is a prefix, or the other way
    round, after suffixes are off; exempt names (past clients) are not.

    Either name is filed under each of its prefixes that is as long as one on the other
    side, and joined on equality: what comes out is matches only."""
    n = names.select(F.col(name).alias("name")).distinct().withColumn("a", T.exclusion_name(F.col("name"))).filter("a <> ''")
    if exempt is not None:
        n = n.join(exempt.select("name").distinct(), "name", "left_anti")
    e = excluded_names.select(T.exclusion_name(F.col("name")).alias("b")).filter("b <> ''").distinct()
    x = prefixes_in(n, "a", e, "b").join(e.withColumnRenamed("b", "__prefix"), "__prefix", "left_semi").select("name")
    short = prefixes_in(e, "b", n, "a").select(F.col("__prefix").alias("a")).distinct()
    return x.union(n.join(short, "a", "left_semi").select("name")).distinct()


def dismissed(items: DataFrame, rules: DataFrame, key: str, signal_type: str) -> DataFrame:
    """(key): items whose company, role_title or location a rule of their signal
    type names, in any case."""
    kinds = [c for c in ("company", "role_title", "location") if c in items.columns]
    values = items.select(F.col(key), F.col(signal_type).alias("signal_type"), F.inline(F.array(*[F.struct(F.lit(k).alias("rule_type"), F.lower(F.col(k)).alias("v")) for k in kinds])))
    r = rules.filter("auto_exclude").select("signal_type", "rule_type", F.lower("rule_value").alias("v")).distinct()
    return values.filter("v <> ''").join(r, ["signal_type", "rule_type", "v"], "left_semi").select(key).distinct()


def without_dismissed(items: DataFrame, rules: DataFrame, signal_type: Column, **values: Column) -> DataFrame:
    """items but those whose value of some kind (company, role_title, location) a rule of
    their signal type names, in any case; a blank value fits no rule."""
    r = rules.filter("auto_exclude").select("signal_type", "rule_type", F.lower("rule_value").alias("__value")).distinct()
    for kind, value in values.items():
        mine = r.filter(F.col("rule_type") == kind).select(F.col("signal_type").alias("__type"), "__value", F.lit(True).alias("__gone"))
        items = lookup(items.withColumns({"__type": signal_type, "__value": F.lower(value)}), mine, ["__type", "__value"]).filter("__gone IS NULL").drop("__type", "__value", "__gone")
    return items


def match_past_to_directory(clients: DataFrame, directory: DataFrame, alternates: DataFrame) -> DataFrame:
    """(client, matched_name, layer): exact directory name, exact alternate,
    directory without suffix, alternate without suffix; of equal keys the last by
    name."""
    plain = lambda c: F.lower(T.clean_name(F.col(c), state=False, passes=4))
    by = lambda df, key, value, alias: df.select(key.alias(alias), F.col(value).alias("v")).filter(f"{alias} <> ''").groupBy(alias).agg(F.max("v").alias(alias + "_v"))
    low = lambda c: F.lower(F.trim(F.col(c)))
    x = clients.select(F.col("name").alias("client")).distinct().withColumn("a", low("client")).withColumn("b", F.col("a")).withColumn("c", plain("client")).withColumn("d", F.col("c"))
    x = x.join(by(directory, low("name"), "name", "a"), "a", "left").join(by(alternates, low("alternate_name"), "directory_name", "b"), "b", "left")
    x = x.join(by(directory, plain("name"), "name", "c"), "c", "left").join(by(alternates, plain("alternate_name"), "directory_name", "d"), "d", "left")
    layer = F.when(F.col("a_v").isNotNull(), 1).when(F.col("b_v").isNotNull(), 2).when(F.col("c_v").isNotNull(), 3).when(F.col("d_v").isNotNull(), 4)
    return x.select("client", F.coalesce("a_v", "b_v", "c_v", "d_v").alias("matched_name"), layer.alias("layer"))


def largest_by_domain(directory: DataFrame) -> DataFrame:
    """(domain, name) of the largest company of each domain."""
    from tidewater.functions.scores import size_rank

    w = F.min(F.struct(-size_rank(F.col("size")), "name"))
    return directory.filter("domain <> ''").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(w.alias("b")).select("domain", F.col("b.name").alias("company_name"))
