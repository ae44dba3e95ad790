"""License scan: canonical digests of entire texts, joined to known ones."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import join_small, packed, table, unpacked
from tidewater.llm.license_texts import EQUIVALENT, FULL, KNOWN

OUT = ("license_id", "notice_ids", "n_notices", "text_digest")

#: A line that only states who holds the copyright, or that rights are reserved.
_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*(copyright|[0-9]{4})|©|all rights reserved)[^\n]*"
#: A paragraph of one line that names the holder only.
_HOLDER = r"(^[ \t\r\n]*|\n[ \t\r]*\n)[^a-z0-9\n]*copyright[ \t]+(?!notice|and |law|license|holder|owner|is |in |of |statement)[^\n]*(?=\n[ \t\r]*\n|\s*\z)"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def normal_lines(text: Column) -> Column:
    """The text in canonical form, its lines kept apart."""
    x = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    # twice: two such lines in a row share a line feed
    for _ in range(2):
        x = F.when(F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("©")) | F.contains(x, F.lit("all rights reserved")), F.regexp_replace(x, _COPYRIGHT, "$1")).otherwise(x)
    x = F.when(F.contains(x, F.lit("copyright")), F.regexp_replace(x, _HOLDER, "$1")).otherwise(x)
    x = F.regexp_replace(x, r"[^a-z0-9\n]+", " ")
    for a, b in EQUIVALENT:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def digest(lines: Column) -> Column:
    """Of canonical lines: white space is one space and none at the ends."""
    return F.sha2(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")).cast("binary"), 256)


def known_digests(spark) -> DataFrame:
    """(digest, license): a table of fixed size, one row for each wording."""
    each = F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("wording")) for i, _, t in KNOWN])
    rows = spark.range(1).select(F.inline(each))
    rows = rows.select(digest(normal_lines(F.col("wording"))).alias("__digest"), "license")
    full = F.array(*[F.struct(F.lit(d).alias("__digest"), F.lit(i).alias("license")) for i, d in FULL])
    return rows.union(spark.range(1).select(F.inline(full))).dropDuplicates(["__digest"])


def scan_licenses(docs: DataFrame, *, text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """All rows of docs with license_id (the known licence that the entire text
    is, or null), notice_ids (the licences that entire lines of it name, each
    once, in order, comma-joined; empty if none), n_notices (such lines) and
    text_digest; input columns of these names are replaced.

    more: (license, wording) rows of further full texts, of any number. Of equal
    wordings the built-in one counts, then the least license.

    Texts are compared in canonical form: case, punctuation, white space,
    copyright lines and equivalent spellings don't count. Null text: as an empty
    one, which is no licence. Repeated rows are scanned alike. Very long texts are
    taken whole. No rows: no rows.

    The lines' digests are looked up in a map of the built-in digests, which are
    few and fixed; only the entire texts' digests are joined.
    """
    fixed = known_digests(docs.sparkSession)
    by_line = F.create_map(*[F.lit(x) for r in fixed.collect() for x in (r["__digest"], r.license)])
    known = fixed.select("__digest", "license")
    if more is not None:
        own = more.select(digest(normal_lines(F.col("wording"))).alias("__digest"), F.col("license").cast("string").alias("license")).filter("license IS NOT NULL")
        both = known.withColumn("z", F.lit(0)).unionByName(own.withColumn("z", F.lit(1)))
        known = both.groupBy("__digest").agg(F.min(F.struct("z", "license"))["license"].alias("license"))
    rows = packed(docs, OUT, __lines=normal_lines(F.col(text)))
    rows = join_small(rows.withColumn("__digest", digest(F.col("__lines"))), known, ["__digest"])
    empty = F.trim(F.regexp_replace(F.col("__lines"), r"\n", " ")) == ""
    found = F.filter(F.transform(F.filter(F.split("__lines", "\n"), lambda x: F.length(x) > 8), lambda x: F.element_at(by_line, digest(x))), lambda x: x.isNotNull())
    out = (
        rows.withColumn("__found", found)
        .withColumn("license_id", F.when(~empty, F.col("license")))
        .withColumn("notice_ids", F.array_join(F.array_sort(F.array_distinct("__found")), ","))
        .withColumn("n_notices", F.size("__found").cast("long"))
        .withColumn("text_digest", F.col("__digest"))
    )
    return unpacked(out, docs, OUT)


def op5(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *OUT)


def _sql_normal(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    y = f"translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}')"
    pattern = _COPYRIGHT.replace("\\n", "\n")
    for _ in range(2):
        y = f"regexp_replace({y}, {q(pattern)}, '\\1', 'g')"
    y = f"regexp_replace({y}, {q('[^a-z0-9' + chr(10) + ']+')}, ' ', 'g')"
    for a, b in EQUIVALENT:
        y = f"replace({y}, {q(a)}, {q(b)})"
    return y


_SQUEEZE = "sha256(trim(regexp_replace(%s, '[ \n]+', ' ', 'g')))"
_VALUES = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, _, t in KNOWN)
OP5_SQL = f"""
WITH k AS (SELECT DISTINCT {_SQUEEZE % _sql_normal("wording")} AS digest, license FROM (VALUES {_VALUES}) v(license, wording)),
d AS (SELECT doc_id, {_sql_normal("text")} AS lines FROM documents),
l AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS ids, count(*) AS n FROM
  (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM d) JOIN k ON length(line) > 8 AND digest = {_SQUEEZE % "line"} GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN trim(replace(lines, chr(10), ' ')) <> '' THEN license END AS license_id,
  coalesce(ids, '') AS notice_ids, coalesce(n, 0)::BIGINT AS n_notices, {_SQUEEZE % "lines"} AS text_digest
FROM d LEFT JOIN k ON k.digest = {_SQUEEZE % "lines"} LEFT JOIN l ON l.doc_id = d.doc_id
"""
