"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import n_words, packed, stored, table, unpacked, without

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, and the most that a source may have, in epochs.
EPOCHS, MOST_EPOCHS = 1.5, 2.0
SEED = "mix-1"
#: Size classes for each doubling of the size.
CLASSES = 8

OUT = ("size", "source_size", "target", "copies", "taken")


def _key(source: str):
    """A key that is never null and tells null from every text."""
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def _unit(x):
    """A number in [0, 1) from a text's MD5."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST_EPOCHS) -> DataFrame:
    """(key, is_null, source_size) -> the same and target.

    Water filling in closed form. With the sources in order of cap / weight, the
    capped ones come first. Let the k first be capped and the rest share what is
    left by weight: this level rises with k as long as the next source would be
    over its cap, and falls after that, so the right one is the greatest."""
    order = Window.orderBy("__null", "__key")
    every = Window.partitionBy()
    by_level = Window.orderBy("__ratio", "__key").rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("__i", F.row_number().over(order) - 1)
        .withColumn("__w", w)
        .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__all", F.sum("source_size").over(every) * F.lit(float(epochs)))
        .withColumn("__sum_w", F.sum("__w").over(every))
        .withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(by_level), F.lit(0.0))) / (F.col("__sum_w") - F.coalesce(F.sum("__w").over(by_level), F.lit(0.0))))
        .withColumn("__free", F.max("__level").over(every))
        .withColumn("target", F.least(F.col("__cap"), F.col("__free") * F.col("__w")))
        .select("__key", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, epochs: float = EPOCHS, most_epochs: float = MOST_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """How many copies of each document the mix takes.

    Each source gets a share of `epochs` times all words, by weight and at most
    `most_epochs` times its own words. Every document of a source then expects
    target / source_size copies. The documents of a source stand in a fixed
    order of size, their expected copies are summed along it, one random offset
    is added for the source, and a document is taken once for each integer that
    its interval of the sum crosses. As neighbours are alike in size, the words
    taken come near the target.

    The sums need no task that sees a whole source: rows are ranked inside
    blocks of (source, size class, salt), with about the square root of all
    rows in a block, and the blocks' offsets come from a sum over the blocks.

    Returns all rows of docs, with size, source_size (long), target (double),
    copies, taken = copies * size (long); input columns of these names are
    replaced. Null text: size 0. Null source: a source of its own, last. Null
    doc_id: ordered first. A source without words: target 0, nothing taken.
    Repeated rows are documents of their own. Very long texts are counted whole.
    No rows: no rows.
    """
    rows = packed(docs, OUT, size=n_words(F.col(text)), __key=_key(source), __id=F.col(doc_id), __hash=F.xxhash64(F.col(text)))
    n = docs.count()
    salts = max(1, math.ceil(math.sqrt(n) / 16))
    sized = (
        rows.withColumn("__class", F.when(F.col("size") == 0, -1).otherwise(F.floor(F.log2(F.col("size").cast("double")) * CLASSES)).cast("int"))
        .withColumn("__salt", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("__id").cast("string"), F.concat(F.lit("t"), "__hash"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(salts)).cast("int"))
    )
    block = ["__key", "__class", "__salt"]
    inside = Window.partitionBy(*block).orderBy("size", F.col("__id").asc_nulls_first(), "__hash")
    ranked = sized.withColumn("__rank", F.row_number().over(inside))
    # stored, as offsets and sources' sizes both come from it: texts are counted here and for the ranks only
    blocks = stored(sized.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words")), "blocks")
    sizes = blocks.groupBy("__key").agg(F.sum("__words").alias("source_size")).withColumn("__null", (F.col("__key") == "n").cast("int"))
    before = Window.partitionBy("__key").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .join(source_targets(sizes, weights, epochs, most_epochs), "__key")
        .select(*block, "__before", "source_size", "target")
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _unit(F.concat(F.lit(seed), F.col("__key")))
    rank = F.col("__before") + F.col("__rank")
    copies = (F.floor(rank * each + start) - F.floor((rank - 1) * each + start)).cast("long")
    out = ranked.join(offsets, block).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return unpacked(out, docs, OUT)


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row of `mixed` for each copy taken, numbered from 1 in copy_no, which
    replaces an input column of that name. A null number of copies or one below 1
    gives no row; repeated rows are copied alike. No rows: no rows."""
    return without(mixed, "copy_no").filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The block structure of mix_sources over the documents table, in DuckDB.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT greatest(1, ceil(sqrt(count(*)) / 16))::BIGINT AS salts FROM d),
b AS (SELECT d.*, CASE WHEN size = 0 THEN -1 ELSE floor(log2(size::DOUBLE) * 8)::INT END AS c,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT % salts AS salt FROM d, p),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c, salt, size, doc_id NULLS FIRST) AS rank FROM b),
s AS (SELECT k, sum(size)::BIGINT AS source_size, (k = 'n')::INT AS last FROM b GROUP BY k),
w AS (SELECT *, (CASE row_number() OVER (ORDER BY last, k) % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END)::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS a FROM s),
l AS (SELECT *, cap / w AS ratio, (a - coalesce(sum(cap) OVER q, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS level
    FROM w WINDOW q AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(cap, (max(level) OVER ()) * w) AS target FROM l),
e AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS x,
    ('0x' || substr(md5('mix-1' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r JOIN t USING (k))
SELECT doc_id, size, source_size, target, CAST(floor(rank * x + u) - floor((rank - 1) * x + u) AS BIGINT) * size AS taken FROM e
"""
