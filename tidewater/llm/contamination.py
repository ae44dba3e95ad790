"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size. Each partition has its length of sketch: an item's
bottom-k MinHash sketch holds the k least of its shingles' hash values, k being a
few more than the shingles that a document may lack. A document is a superset of an
item, however long it is, so it is not sketched: containment is estimated by how
many of the sketch's minima it holds, and a document that holds enough of the item
holds at least k less those that it may lack. No contained item is missed, wherever
its shingles stand in the document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bit_table, in_table, join_small, packed, small, stored, table, unpacked
from tidewater.llm.shingles import shingles

#: Words of a shingle, and the share of an item's shingles that a document must
#: hold, in hundredths.
WORDS, SIMILAR = 5, 80
#: Minima of a sketch beyond those that may be lacking: so many must be found.
HITS = 3
OUT = ("item_ids", "contaminated")


def size_class(n: int) -> int:
    """Items of 2**c to 2**(c+1) - 1 shingles are of class c."""
    return n.bit_length() - 1


def lacking(n: int, similar: int) -> int:
    """Shingles of n that a document may lack."""
    return n - -(-similar * n // 100)


def sketch_length(c: int, similar: int) -> int:
    """k of a size class: as its largest item needs."""
    return lacking((2 << c) - 1, similar) + HITS


def _item_rows(similar: int):
    """(item, unit, n, need, keys, tokens): unit tells wordings apart; need is how
    many of the keys a document must hold."""

    def run(batches):
        for batch in small(batches):
            out = {"item": [], "n": [], "need": [], "keys": [], "tokens": []}
            for i, t in zip(batch.column(0), batch.column(1)):
                s = shingles(t.as_py(), WORDS, short=False)
                if len(s):
                    k = min(len(s), sketch_length(size_class(len(s)), similar))
                    out["item"].append(i.as_py())
                    out["n"].append(len(s))
                    out["need"].append(max(1, k - lacking(len(s), similar)))
                    out["keys"].append(s[:k].view(np.int64).tolist())
                    out["tokens"].append(s.view(np.int64).tolist())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def _document_rows(sketches, every):
    """(row, keys, tokens) of documents with a shingle that may be in a sketch;
    tokens are those that may be in some item."""

    def run(batches):
        first, second = sketches.value, every.value
        for batch in small(batches):
            rows, keys, tokens = [], [], []
            for row, text in zip(batch.column(0), batch.column(1)):
                s = shingles(text.as_py(), WORDS, short=False)
                hit = s[in_table(first, s)]
                if len(hit):
                    rows.append(row.as_py())
                    keys.append(hit.view(np.int64).tolist())
                    tokens.append(s[in_table(second, s)].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))], ["row", "keys", "tokens"])

    return run


def row_key(text: str):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def contained_items(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(row, item_id, n_shared, n_item): the items of which a document text holds at
    least `similar` hundredths of the distinct 5-word shingles; row is the text's
    MD5 (row_key). Counts are exact, over the whole document.

    Documents are sent on only if one of their shingles passes a filter of the
    sketches, and of these only the shingles that pass a filter of all items'; a
    candidate pair must share enough of the sketch before its shingles are counted.

    An item with less than five words has no shingle and is found nowhere. Rows
    with one item id and several texts are items of their own.
    """
    wordings = items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).distinct()
    made = wordings.mapInArrow(_item_rows(similar), "item long, n long, need long, keys array<long>, tokens array<long>")
    item = stored(made.withColumn("unit", F.xxhash64("item", "tokens")).dropDuplicates(["unit"]), "items")
    sketches, every = (bit_table(item.select(F.explode(c).alias("value")).distinct()) for c in ("keys", "tokens"))
    texts = docs.select(row_key(text).alias("row"), F.col(text).cast("string").alias("text"))
    near = stored(texts.mapInArrow(_document_rows(sketches, every), "row string, keys array<long>, tokens array<long>").dropDuplicates(["row"]), "near")
    by_key = item.select("unit", "need", F.explode("keys").alias("key"))
    hits = near.select("row", F.explode("keys").alias("key")).join(by_key, "key").groupBy("row", "unit").agg(F.count(F.lit(1)).alias("found"), F.max("need").alias("need"))
    pairs = hits.filter("found >= need").select("row", "unit")
    both = pairs.join(near.select("row", F.col("tokens").alias("t1")), "row").join(item.select("unit", "item", "n", F.col("tokens").alias("t2")), "unit")
    shared = F.size(F.array_intersect("t1", "t2")).cast("long")
    return both.select("row", F.col("item").alias(item_id), shared.alias("n_shared"), F.col("n").alias("n_item")).filter(100 * F.col("n_shared") >= similar * F.col("n_item")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """All rows of docs with item_ids (the contained items' ids in order, an
    empty array if none) and contaminated; input columns of these names are
    replaced.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null or
    empty text: contains nothing. Null item text or id: no item. Repeated rows
    and items are found alike. Very long texts are searched whole. No items or no
    rows: nothing is contaminated.
    """
    found = contained_items(docs, items.filter(F.col(item_id).isNotNull()), text=text, item_id=item_id, item_text=item_text, similar=similar)
    by_row = stored(found.groupBy("row").agg(F.array_sort(F.collect_set(item_id)).alias("item_ids")), "leaks")
    out = join_small(packed(docs, OUT, row=row_key(text)), by_row, ["row"])
    out = out.withColumn("item_ids", F.coalesce("item_ids", F.expr("CAST(array() AS array<bigint>)")))
    return unpacked(out.withColumn("contaminated", F.size("item_ids") > 0), docs, OUT)


def op6(spark, sf_dir):
    """(doc_id, item_id, n_shared, n_item): a row for each contained item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contained_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    by_row = stored(found.groupBy("row").agg(F.collect_list(F.struct("item_id", "n_shared", "n_item")).alias("found")), "leaks")
    return join_small(docs.select("doc_id", row_key("text").alias("row")), by_row, ["row"], "inner").select("doc_id", F.inline("found"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAMS = "(SELECT DISTINCT %s AS id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM (SELECT *, regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+') AS w FROM %s)))"
OP6_SQL = f"""
WITH d AS {_GRAMS % ("doc_id", "documents")}, b AS {_GRAMS % ("item_id", "benchmark")},
n AS (SELECT id, count(*)::BIGINT AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared, any_value(n.n) AS n_item
FROM d JOIN b USING (g) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
