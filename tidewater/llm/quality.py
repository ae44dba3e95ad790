"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import join_small, packed, small, stored, table, unpacked

#: Base rules of the contract.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"

#: A sketch keeps a count for each bucket; a value's bucket is the value with
#: all but its first 6 binary digits cleared, so a quantile is at most 1/32 low.
DIGITS = 6
#: A group takes its language's sketch, and a language that of all documents, if
#: fewer than a quarter of LEAST_DOCS documents stand above the quantile.
LEAST_DOCS = 50
#: Measures (per mille, word_length in hundredths of a code point): the upper
#: quantile in percent, how often its distance from the median is added to it, the
#: least distance (as most documents may have the same value).
RULES = {"symbols": (75, 6, 1), "dup_lines": (98, 2, 50), "repeated": (98, 2, 50), "word_length": (75, 6, 16)}

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
OUT = (*STATS, "base_failed", "kept", "reason")


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of a text; all 0 for none."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    joined = b" ".join(words)
    # continuation bytes are no code points of their own
    chars = len(joined.decode("utf-8", "surrogatepass")) - max(0, n - 1)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = n_lines = 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > WINDOW:
        at, ends = 0, []
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *ends[: n - WINDOW]]
        windows = [joined[a : b - 1] for a, b in zip(starts, ends[WINDOW - 1 :])]
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return n, chars, symbols, dup, repeat, n_lines


def _with_stats(batches):
    for batch in small(batches):
        texts = batch.column(batch.schema.get_field_index("__text"))
        stats = [text_stats(t.as_py()) for t in texts]
        keep = [i for i, f in enumerate(batch.schema) if f.name != "__text"]
        columns = [pa.array([s[k] for s in stats], pa.int64()) for k in range(len(STATS))]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + columns, [batch.schema.field(i).name for i in keep] + list(STATS))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATS; a column __text is not kept."""
    rows = docs.withColumn("__text", F.col(text).cast("string"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "__text"], *[T.StructField(c, T.LongType()) for c in STATS]])
    return rows.mapInArrow(_with_stats, schema)


def bucket(value: Column) -> Column:
    """The bucket of a value >= 0 in a sketch."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))).cast("long")
    return value - F.pmod(value, unit)


def measures() -> dict[str, Column]:
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    whole = lambda a, b: F.floor(a / b).cast("long")
    return {
        "symbols": whole(1000 * c("n_symbols"), F.greatest(c("word_chars"), F.lit(1))),
        "dup_lines": whole(1000 * c("n_dup_lines"), F.greatest(c("n_lines"), F.lit(1))),
        "repeated": whole(1000 * c("n_repeat_words"), n),
        "word_length": whole(100 * c("word_chars"), n),
    }


def sketch(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): a sketch for each group and measure. Two
    sketches are merged by adding the counts of equal buckets, so that it doesn't
    matter how rows are dealt out."""
    rows = stats.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in measures().items()])))
    return rows.groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _cutoffs(merged: DataFrame, keys: list[str], rules: dict) -> DataFrame:
    """(keys, measure, enough, cutoff) from sketches: of each group the buckets
    and counts stand in one array, whose length the digits bound."""
    groups = merged.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("n_docs"))
    for i, name in enumerate(("__percent", "__reach", "__least")):
        groups = groups.withColumn(name, F.element_at(F.create_map(*[F.lit(x) for m, rule in rules.items() for x in (m, rule[i])]), F.col("measure")).cast("long"))
    quantile = "element_at(filter(aggregate(b, named_struct('t', 0L, 'o', CAST(array() AS array<struct<bucket: bigint, t: bigint>>)), (a, x) -> named_struct('t', a.t + x.n, 'o', concat(a.o, array(named_struct('bucket', x.bucket, 't', a.t + x.n))))).o, y -> y.t * 100 >= n_docs * %s), 1).bucket"
    return (
        groups.withColumn("__mid", F.expr(quantile % "50")).withColumn("__high", F.expr(quantile % "__percent"))
        .withColumn("__spread", F.greatest(F.col("__high") - F.col("__mid"), F.col("__least")))
        .select(*keys, "measure", (F.col("n_docs") * (100 - F.col("__percent")) >= 25 * LEAST_DOCS).alias("enough"), (F.col("__high") + F.col("__reach") * F.col("__spread")).alias("cutoff"))
    )


def thresholds(stats: DataFrame, rules: dict = RULES) -> DataFrame:
    """(__lang, __source, cutoffs map measure -> cutoff) for each language and
    source, from the sketch of the smallest group that is large enough."""
    fine = sketch(stats, ["__lang", "__source"])
    by_lang = fine.groupBy("__lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    a = _cutoffs(fine, ["__lang", "__source"], rules)
    b = _cutoffs(by_lang, ["__lang"], rules).select("__lang", "measure", F.col("enough").alias("__enough_b"), F.col("cutoff").alias("__c_b"))
    c = _cutoffs(by_all, [], rules).select("measure", F.col("cutoff").alias("__c_c"))
    pick = F.when(F.col("enough"), F.col("cutoff")).when(F.col("__enough_b"), F.col("__c_b")).otherwise(F.col("__c_c"))
    chosen = a.join(b, ["__lang", "measure"]).join(F.broadcast(c), "measure").withColumn("__pick", pick)
    return chosen.groupBy("__lang", "__source").agg(F.map_from_entries(F.collect_list(F.struct("measure", "__pick"))).alias("__cutoffs"))


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))


def judge_quality(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", rules: dict = RULES) -> DataFrame:
    """All rows of docs with STATS, base_failed, kept and reason (the first rule
    that a document breaks, else null); input columns of these names are
    replaced.

    base_failed: fewer than 20 words, or more than 30% of the words in repeated
    windows of 8. Of the others, a document is not kept if one of its measures
    is above its language and source's cutoff. The documents that aren't
    base_failed are in the sketches.

    Null text: no words, so base_failed. Null language or source: a group of its
    own. Repeated rows are judged alike. Very long texts are counted whole. No
    rows: no rows.
    """
    named = {"__lang": _key(lang), "__source": _key(source), "__text": F.col(text).cast("string")}
    rows, slim = with_stats(packed(docs, OUT, **named), "__text"), with_stats(docs.select(*[v.alias(k) for k, v in named.items()]), "__text")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    limits = stored(thresholds(slim.filter(~base), rules), "cutoffs")
    reason = F.when(base, "base")
    for m, v in measures().items():
        reason = reason.when(v > F.element_at("__cutoffs", m), m)
    out = join_small(rows, limits, ["__lang", "__source"])
    return unpacked(out.withColumn("base_failed", base).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()), docs, OUT)


def op3(spark, sf_dir):
    out = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Windows and lines are numbered and compared as lists; sketches as in sketch().
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
li AS (SELECT r, i, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM li GROUP BY r),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
s AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN ln USING (r) LEFT JOIN cov ON cov.r = d.r),
f AS (SELECT s.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s),
m AS (SELECT r, lang, source, measure, value FROM f, LATERAL (VALUES ('symbols', 1000 * n_symbols // greatest(word_chars, 1)),
    ('dup_lines', 1000 * n_dup_lines // greatest(n_lines, 1)), ('repeated', 1000 * n_repeat_words // greatest(n_words, 1)),
    ('word_length', 100 * word_chars // greatest(n_words, 1))) v(measure, value) WHERE NOT base_failed),
b AS (SELECT lang, source, measure, value - value % greatest(1, (2 ** (length(bin(value)) - 6))::BIGINT) AS bucket FROM m),
u(measure, percent, reach, least) AS (VALUES ('symbols', 75, 6, 1), ('dup_lines', 98, 2, 50), ('repeated', 98, 2, 50), ('word_length', 75, 6, 16)),
q AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(bucket, [0.5, 0.75, 0.98]) AS q FROM b GROUP BY ALL),
ql AS (SELECT lang, measure, count(*) AS n, quantile_disc(bucket, [0.5, 0.75, 0.98]) AS q FROM b GROUP BY ALL),
qa AS (SELECT measure, quantile_disc(bucket, [0.5, 0.75, 0.98]) AS q FROM b GROUP BY ALL),
g AS (SELECT q.lang, q.source, q.measure, percent, reach, least, CASE WHEN q.n * (100 - percent) >= 25 * 50 THEN q.q WHEN ql.n * (100 - percent) >= 25 * 50 THEN ql.q ELSE qa.q END AS q
    FROM q JOIN ql USING (lang, measure) JOIN qa ON qa.measure = q.measure JOIN u ON u.measure = q.measure),
h AS (SELECT *, q[1] AS mid, CASE percent WHEN 75 THEN q[2] ELSE q[3] END AS high FROM g),
cut AS (SELECT lang, source, measure, high + reach * greatest(high - mid, least) AS cutoff FROM h),
bad AS (SELECT DISTINCT r FROM m JOIN cut USING (lang, source, measure) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f
"""
