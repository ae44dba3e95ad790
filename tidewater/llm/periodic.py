"""Periodic runs of words, found with a suffix tree and collapsed to one period."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, packed, table, unpacked
from tidewater.llm.suffix_tree import maximal_runs

#: The least words of a run, and how many times its period it has at least.
SHORTEST, TIMES = 24, 3
#: Words that one suffix tree holds, unless a text has more.
TREE = 1 << 18

OUT = ("n_words", "runs", "collapsed")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(texts: list[list[bytes]], shortest: int, times: int) -> list[tuple[int, list, bytes]]:
    """(words, runs, text without the later periods of runs) of each text."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = [list(map(number.__getitem__, words)) for words in texts]
    sizes = np.array([len(x) for x in ids], np.int64)
    # separators around and between the texts, above all words' numbers
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    w = np.empty(int(at[-1]) + 1, np.int64)
    w[at] = len(number) + np.arange(len(at))
    rest = np.ones(len(w), bool)
    rest[at] = False
    w[rest] = np.concatenate([np.zeros(0, np.int64), *ids])
    begin, length, period = maximal_runs(w, shortest, times)
    owner = np.searchsorted(at, begin, "right") - 1
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    kept, runs = np.cumsum(change) == 0, defaultdict(list)
    for o, *run in zip(owner.tolist(), (begin - at[owner] - 1).tolist(), length.tolist(), period.tolist()):
        runs[o].append(dict(zip(("start", "length", "period"), run)))
    out = []
    for i, words in enumerate(texts):
        if i in runs:
            words = [x for x, k in zip(words, kept[at[i] + 1 : at[i + 1]].tolist()) if k]
        out.append((int(sizes[i]), runs.get(i, []), b" ".join(words)))
    return out


def _runs_of(shortest: int, times: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held, size = [], [], 0
            for x in batch.cast(pa.large_binary()):
                held.append((x.as_py() or b"").split())
                size += len(held[-1])
                if size >= TREE:
                    out += _found(held, shortest, times)
                    held, size = [], 0
            out += _found(held, shortest, times) if held else []
            n, runs, collapsed = zip(*out) if out else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, *, text: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """docs with n_words; runs: the stretches of at least `shortest` words and `times`
    periods that no neighbouring word extends, as (start, length, period) in order,
    words counted from 0; collapsed: the words, joined by one space, without those that
    stand behind the first period of some run.

    Runs that overlap are all given. Null or empty text: no words, no runs, an empty
    text. Repeated rows are alike. A text is taken whole, in one suffix tree, in memory
    that grows with its length (about 200 bytes a word). Input columns of the names of
    the new ones are replaced. No rows: no rows."""
    rows = packed(docs, OUT, __text=F.col(text).cast("string"))
    found = rows.withColumn("__found", F.arrow_udf(_runs_of(shortest, times), _FOUND)("__text"))
    return unpacked(found.select("*", "__found.*"), docs, OUT)


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs; in one text of ten, by the id's checksum, the words from some place on
    repeat the first of them. Null id or text: unchanged."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    planted = F.expr("transform(__w, (x, i) -> CASE WHEN i < __a THEN x ELSE get(__w, CAST(__a + (i - __a) % (1 + floor((size(__w) - __a) / (3 + __g % 8))) AS INT)) END)")
    rows = packed(docs, (text,), __t=F.col(text), __h=h).withColumn("__g", F.floor(F.col("__h") / 10))
    rows = rows.withColumn("__w", F.when(F.col("__h") % 10 == 0, F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("__a", F.when(F.size("__w") > 0, F.col("__g") % F.size("__w")))
    return unpacked(rows.withColumn(text, F.when(F.size("__w") > 0, F.array_join(planted, " ")).otherwise(F.col("__t"))), docs, (text,))


def op12(spark, sf_dir):
    found = collapse_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length / period, then least start, then least period
    better = "x.length * a.period > a.length * x.period OR (x.length * a.period = a.length * x.period AND (x.start < a.start OR (x.start = a.start AND x.period < a.period)))"
    best = F.expr(f"aggregate(runs, CAST(NULL AS struct<start:long,length:long,period:long>), (a, x) -> CASE WHEN a IS NULL OR {better} THEN x ELSE a END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = found.withColumn("b", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"b.{k}").alias(k) for k in ("start", "length", "period")],
        F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The checksum bit by bit; runs by comparing each text with itself, moved by every
#: distance at which some 16 words recur: a run of 24 words and 3 periods has such.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, len(doc_id::VARCHAR) AS l FROM documents),
h AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, l + 1), lambda k: [ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS h FROM d),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
t AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END) END AS w FROM a),
i AS (SELECT r, unnest(range(0, len(w))) AS i, unnest(w) AS w, len(w) AS n FROM t),
m AS (SELECT r, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS m FROM (SELECT r, w, len(w) AS n, unnest(range(0, len(w) - 15)) AS i FROM t)),
q AS (SELECT DISTINCT x.r, y.i - x.i AS q FROM m x JOIN m y ON x.r = y.r AND x.m = y.m AND x.i < y.i WHERE 3 * (y.i - x.i) <= x.n),
e AS (SELECT q.r, q, x.i FROM q JOIN i x ON x.r = q.r JOIN i y ON y.r = q.r AND y.i = x.i + q AND y.w = x.w),
s AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b FROM e) GROUP BY r, q, b HAVING count(*) + q >= greatest(24, 3 * q)),
u AS (SELECT r, s, l, min(q) AS q FROM s GROUP BY ALL),
b AS (SELECT r, count(*) AS n, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS h,
    arg_min({'s': s, 'l': l, 'q': q}, {'x': -(l::DECIMAL(38, 0) * 1000000000000 // q), 's': s, 'q': q}) AS b FROM u GROUP BY r),
k AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS k FROM i WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = i.r AND i.i >= u.s + u.q AND i.i < u.s + u.l) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_runs, b.b.s::BIGINT AS start, b.b.l::BIGINT AS length, b.b.q::BIGINT AS period, (1000 * b.b.l // b.b.q)::BIGINT AS exponent_milli,
  coalesce(b.h, sha256('')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256 FROM t LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""
