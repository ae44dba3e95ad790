"""N-gram Jaccard join: signature trees inside shards that hold every link.

The shards come from agreement on parts of a set. If two sets of at most M
tokens have Jaccard similarity p/q or more, their symmetric difference has at
most d = floor(2 M (q - p) / (q + p)) tokens. Deal the tokens by hash into K > d
parts: at least K - d parts of the two sets are equal. So the two meet in the
shard of an equal part (Arasu et al., 2006). With its parts in order of size, and
of a hash of their tokens, a document goes to the shards of all but its K - d - 1
first. Equal parts stand alike in this order, so the last of the K - d is behind
the K - d - 1 first in both documents: no link is lost, and parts of few tokens,
which unrelated documents may share, are not used.

In each shard a signature tree holds the sets' bitmaps, and its dual traversal
gives the pairs that can be similar; they are verified on the exact sets. A first
round takes some shards, and of their possible pairs only as many as connect them
all; the second does so with all shards that still hold several components. Near
copies are then mostly in one component. The third round takes the shards that
still hold several, and in each all pairs between different ones. No shard is taken
by one task: its members are dealt to blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bit_table, discard, grouped, in_table, packed, small, stored, table, unpacked
from tidewater.llm.components import components, joined
from tidewater.llm.shingles import mixed, shingles
from tidewater.llm.signature_tree import SignatureTree, bitmap, dual_traversal, folded

WORDS, SIMILAR = 5, (80, 100)
#: Members of one task's share of a shard; a join takes so many blocks at a time.
BLOCK, BLOCKS = 512, 8
#: The first round takes one in so many shards; the later ones miss none.
FIRST = 8
OUT = ("n_shingles", "component_id")
#: Size classes grow by half.
_STARTS = [1]
while _STARTS[-1] < 1 << 40:
    _STARTS.append(max(_STARTS[-1] + 1, _STARTS[-1] * 3 // 2))
_STARTS = np.array(_STARTS)


def size_class(n: int) -> int:
    return int(np.searchsorted(_STARTS, n, "right")) - 1


def parts_of(c: int, p: int, q: int) -> tuple[int, int]:
    """(K, d) for pairs whose larger set is of class c."""
    d = 2 * (int(_STARTS[c + 1]) - 1) * (q - p) // (q + p)
    return d + 1 + (d + 1) // 2, d


def width_of(c: int) -> int:
    """Bits of the bitmaps of class c: at least two a token, a power of two."""
    return max(64, 1 << (2 * int(_STARTS[c + 1]) - 1).bit_length())


def shard_keys(tokens: np.ndarray, p: int, q: int) -> np.ndarray:
    """Keys of the shards of a set: of its own class, and of the next if a set
    there can be similar to it."""
    n = len(tokens)
    c = size_class(n)
    out = []
    for k in (c, c + 1) if q * n >= p * int(_STARTS[c + 1]) else (c,):
        parts, d = parts_of(k, p, q)
        if d == 0:
            continue  # only equal sets can be similar
        part = ((tokens >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=parts)
        total = np.zeros(parts, np.uint64)
        full = np.flatnonzero(count)
        starts = np.cumsum(count) - count
        total[full] = np.add.reduceat(mixed(tokens[order] * np.uint64(0xD6E8FEB86659FD93)), starts[full])
        use = np.lexsort((total, count))[parts - d - 1 :]
        salt = np.uint64((k * 0x9E3779B97F4A7C15 + p * 1_000_003 + q) % 2**64)
        keys = mixed(mixed(total[use] + salt) * np.uint64(0x9FB21C651E98DF25) + use.astype(np.uint64))
        out.append(keys.view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _node(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


_TOKENS = "doc_id long, row long, n long, node binary, bits binary, keys array<long>"


def _tokenise(k: int, p: int, q: int):
    def run(batches):
        for batch in small(batches):
            out = {c: [] for c in ("n", "node", "bits", "keys")}
            for t in batch.column(2):
                s = shingles(t.as_py(), k)
                out["n"].append(len(s))
                out["node"].append(_node(s))
                out["bits"].append(bitmap(s, width_of(size_class(len(s)) + 1)).tobytes() if len(s) else b"")
                out["keys"].append(shard_keys(s, p, q) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out["n"], pa.int64()), pa.array(out["node"], pa.binary()), pa.array(out["bits"], pa.binary()), pa.array(out["keys"], pa.list_(pa.int64()))], ["doc_id", "row", "n", "node", "bits", "keys"])

    return run


def _passing(common):
    """(key, number) for each key that the table may hold."""

    def run(batches):
        table = common.value
        for batch in small(batches):
            keys = batch.column(1).flatten().to_numpy()
            numbers = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            keep = in_table(table, (keys >> 32).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(numbers[keep])], ["key", "number"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in small(batches):
            found = [shingles(t.as_py(), k) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "tokens"])

    return run


def _tree(t: pa.Table, width: int, groups: np.ndarray | None = None) -> SignatureTree:
    bits = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("bits")]
    bits = np.stack([folded(x, width) for x in bits])
    return SignatureTree(t.column("n").to_numpy(), bits, groups)


def _width(t: pa.Table) -> int:
    """Bits of the narrowest bitmap, to which the others are folded."""
    return 8 * min(len(x.as_py()) for x in t.column("bits"))


def _connecting(p: int, q: int):
    """Of each block, possible pairs that connect all that possible pairs do, and
    that known components (roots) don't yet."""

    def run(batches):
        for t in grouped(batches, ["key", "block"]):
            tree = _tree(t, _width(t))
            roots = t.column("root").to_pylist()
            place = {r: i for i, r in reversed(list(enumerate(roots)))}
            up = [place[r] for r in roots]

            def root(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            node, pairs = t.column("node").to_pylist(), []
            for i, j in dual_traversal(tree, tree, p, q):
                for a, b in zip(i.tolist(), j.tolist()):
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        up[ra] = rb
                        pairs.append((a, b))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([min(node[a], node[b]) for a, b in pairs], pa.binary()), pa.array([max(node[a], node[b]) for a, b in pairs], pa.binary())], ["a", "b"])

    return run


def _connect(rows: DataFrame, bits: DataFrame, p: int, q: int) -> DataFrame:
    """Candidate pairs that connect shards: rows (key, n_members, node, root). A
    large shard's blocks each hold its least member too, which connects them."""
    blocks = F.ceil(F.col("n_members") / BLOCK).cast("int")
    own = F.pmod(_hash("node"), blocks).cast("int")
    least = rows.filter(F.col("n_members") > BLOCK).groupBy("key").agg(F.min("node").alias("node"))
    first = rows.join(least, ["key", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).filter(F.col("block") != own)
    dealt = rows.withColumn("block", own).unionByName(first).select("key", "block", "node", "root").join(bits, "node")
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_connecting(p, q), "a binary, b binary").distinct()


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, other, n_left, n_members): of the shards that hold several
    components all members; other: outside the shard's main component, as n_left are."""
    state = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    several = by_root.groupBy("key").agg(F.count(F.lit(1)).alias("n_roots"), F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n_all"), F.max("c").alias("n_main")).filter("n_roots > 1")
    # a large shard's members are dealt over salts, for which its row is repeated
    salts = lambda n: F.ceil(F.col(n) / (BLOCK * BLOCKS)).cast("int")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), salts("n_all") - 1))).select("key", "salt", "main", (F.col("n_all") - F.col("n_main")).alias("n_left"))
    out = state.withColumn("salt", F.pmod(_hash("node"), salts("n_members")).cast("int")).join(several, ["key", "salt"])
    return stored(out.select("key", "node", "root", (F.col("root") != F.col("main")).alias("other"), "n_left", "n_members"), "open")


def _crossing(p: int, q: int):
    """Of each pair of blocks, all possible pairs between components."""

    def run(batches):
        for t in grouped(batches, ["key", "left_block", "block"]):
            side = t.column("left").to_numpy(zero_copy_only=False)
            roots = t.column("root").to_pylist()
            number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
            group = np.array([number[r] for r in roots])
            i, j = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(i) or not len(j):
                continue
            node = t.column("node").to_pylist()
            width = _width(t)
            x, y = _tree(t.take(pa.array(i)), width, group[i]), _tree(t.take(pa.array(j)), width, group[j])
            for a, b in dual_traversal(x, y, p, q):
                one, two = [node[k] for k in i[a]], [node[k] for k in j[b]]
                yield pa.RecordBatch.from_arrays([pa.array([min(*x) for x in zip(one, two)], pa.binary()), pa.array([max(*x) for x in zip(one, two)], pa.binary())], ["a", "b"])

    return run


def _verified(p: int, q: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(s) + len(t)
                common = both - len(np.union1d(s, t))
                keep.append(q * common >= p * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb").mapInArrow(_verified(p, q), "a binary, b binary")


def _hash(*c):
    return F.xxhash64(*c)


def link(docs: DataFrame, words: int, similar: tuple[int, int], doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens: a row for each document; links: verified links (a, b) that
    connect all that links do; roots: (node, root) of linked nodes). Nodes are
    distinct sets."""
    p, q = similar
    row = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"), F.col(text).cast("string").alias("text"))
    wide = stored(rows.mapInArrow(_tokenise(words, p, q), _TOKENS), "wide")
    tokens = stored(wide.select("doc_id", "row", "n", "node"), "tokens")
    first_row = tokens.filter("n > 0").groupBy("node").agg(F.min("row").alias("row"))
    nodes = wide.filter("n > 0").join(first_row, ["node", "row"], "left_semi").withColumn("number", _hash("node"))
    # keys that several rows may have, by a table of their high halves; a very common key is one count for each partition
    high = nodes.select(F.explode("keys").alias("key")).groupBy(F.shiftright("key", 32).cast("int").alias("high")).agg(F.count(F.lit(1)).alias("n"))
    common = stored(high.filter("n > 1").select(F.col("high").cast("long").alias("value")), "common")
    passing = nodes.select("number", "keys").mapInArrow(_passing(bit_table(common)), "key long, number long")
    shared = stored(passing.distinct(), "shared")
    # each shard's size, and two sums that tell sets of nodes apart
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n_members"), F.bit_xor("number").alias("x"), F.sum(_hash("number").cast("decimal(20)")).alias("y")).filter("n_members > 1")
    # shards with the same members are one
    shards = sizes.groupBy("n_members", "x", "y").agg(F.min("key").alias("key")).select("key", "n_members")
    # joined by sorting at every size: a broadcast of what grows would end in a shuffle later
    kept = stored(shared.join(shards.hint("merge"), "key").select("key", "n_members", "number"), "kept")
    about = nodes.select("number", "node", "row", "n", "bits").dropDuplicates(["node", "row"])
    about = stored(about.join(kept.select("number").distinct().hint("merge"), "number", "left_semi"), "about")
    members = stored(kept.join(about.select("number", "node").hint("merge"), "number").select("key", "n_members", "node"), "members")
    discard(wide)
    discard(shared)
    discard(kept)
    bits = about.select("node", "n", "bits")
    # first round: links of some shards
    some = members.filter(F.pmod(_hash("key"), F.lit(FIRST)) == 0).withColumn("root", F.col("node"))
    tried = stored(_connect(some, bits, p, q), "tried")
    # the exact sets of nodes in some shard, from one of their documents
    wanted = about.select("row").distinct()
    sets = stored(rows.join(wanted.hint("merge"), "row", "left_semi").select("text").mapInArrow(_sets(words), "node binary, tokens binary").dropDuplicates(["node"]), "sets")
    links = stored(_verify(tried, sets, p, q), "links")
    roots = components(links)
    # second round: the same for all shards that still hold several components
    open_ = _open(members, roots)
    if open_.isEmpty():
        return tokens, links, roots
    more = stored(_connect(open_, bits, p, q).join(tried, ["a", "b"], "left_anti"), "more")
    found = stored(_verify(more, sets, p, q), "links")
    if not found.isEmpty():
        tried, links = tried.union(more), links.union(found)
        roots = joined(roots, found)
        discard(open_)
        open_ = _open(members, roots)
        if open_.isEmpty():
            return tokens, links, roots
    # third round: members outside a shard's main component (left) against all, in blocks of both
    n_left, n_all = F.ceil(F.col("n_left") / BLOCK).cast("int"), F.ceil(F.col("n_members") / BLOCK).cast("int")
    left = open_.filter("other").withColumn("left", F.lit(True)).withColumn("left_block", F.pmod(_hash("node"), n_left).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_all - 1)))
    right = open_.withColumn("left", F.lit(False)).withColumn("block", F.pmod(_hash("node"), n_all).cast("int")).withColumn("left_block", F.explode(F.sequence(F.lit(0), n_left - 1)))
    both = left.unionByName(right).select("key", "left_block", "block", "left", "node", "root").join(bits, "node")
    both = both.repartition("key", "left_block", "block").sortWithinPartitions("key", "left_block", "block")
    more = stored(both.mapInArrow(_crossing(p, q), "a binary, b binary").distinct().join(tried, ["a", "b"], "left_anti"), "more")
    found = stored(_verify(more, sets, p, q), "links")
    discard(open_)
    discard(more)
    if not found.isEmpty():
        links = links.union(found)
        roots = joined(roots, found)
    return tokens, links, roots


def ngram_join(docs: DataFrame, *, words: int = WORDS, similar: tuple[int, int] = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs. Two
    documents link if q times their common shingles reach p times all their
    shingles, similar = (p, q); component_id is the least doc_id that links
    reach.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text
    with fewer words than a shingle has is one shingle; a null text, an empty one
    and one of white space have none and link with nothing. Repeated rows and
    equal sets are in one component. Null doc_id: the row is linked like others,
    but gives no component its id; where all are null, component_id is null.
    Very long texts are taken whole. Other columns are left out. No rows: no rows.
    """
    tokens, _, roots = link(docs, words, similar, doc_id, text)
    return _labelled(tokens, roots).select(F.col("doc_id").alias(doc_id), "n_shingles", "component_id")


def _labelled(tokens: DataFrame, roots: DataFrame) -> DataFrame:
    by_node = tokens.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("__least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # stored, so that both sides of the join are read by key: Spark splits the key of a large component
    by_root = stored(by_node.groupBy("root").agg(F.min("__least").alias("__component")), "by-root")
    label = by_node.join(by_root, "root").select("node", "__component")
    return tokens.join(label, "node", "left").select("doc_id", "row", "node", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("__component")).otherwise(F.col("doc_id")).alias("component_id"))


def op1(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, similar=(90, 100))


def drop_near_duplicates(docs: DataFrame, *, words: int = WORDS, similar: tuple[int, int] = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the row with the least doc_id (null
    last), of ties one. Rows without words are components of their own; rows
    that are equal in doc_id and text are one, the first in order of the other
    columns as JSON. Null text: as an empty one. Very long texts are taken whole.
    No rows: no rows."""
    tokens, _, roots = link(docs, words, similar, doc_id, text)
    node = tokens.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("best"))
    node = node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    none = F.lit(-(2**63)).cast("long")
    stay = node.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"), F.coalesce("best.doc_id", none).alias("__id"))
    stay = stay.union(tokens.filter("n = 0").select("row", F.coalesce("doc_id", none))).distinct()
    row = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(doc_id).cast("long"), none))
    kept = packed(docs, (), __row=row, __id=F.coalesce(F.col(doc_id).cast("long"), none)).join(stay, ["__row", "__id"], "left_semi")
    others = [c for c in docs.columns if c not in (doc_id, text)]
    first = F.to_json(F.struct(*[F.col(f"__in.`{c}`") for c in others])) if others else F.lit("")
    return unpacked(kept.groupBy("__row", "__id").agg(F.min_by("__in", first).alias("__in")), docs, ())


#: All pairs that share a shingle, and the least id by walking the links.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT r, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 1, 2) END)) AS i FROM w)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
c AS (SELECT r, r AS t FROM w UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.t)
SELECT any_value(x.doc_id) AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(y.doc_id)::BIGINT AS component_id
FROM c JOIN w x ON x.r = c.r JOIN w y ON y.r = c.t LEFT JOIN n ON n.r = c.r GROUP BY c.r
"""
