"""Near duplicates among embeddings: spherical k-means cells, blocked cosines.

Vectors go to the cell of the centroid with the greatest cosine. Two vectors of one
cell that both stand within half the linking angle of its centroid link without any
product: they are its core, counted by one aggregate, so that a group of near copies
costs nothing for its pairs. Other pairs are compared by matrix products of blocks.
Pairs across cells aren't lost: a vector also visits each later cell that its partner
could belong to. If y's nearest centroid is b and x's is a, y stands on b's side of
the plane between them, and x is at most the linking angle from y; so x is at most
that angle from b's side: (x.a - x.b) / |a - b| <= sin(angle). All bounds are exact."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, grouped, join_small, packed, small, stored, table, unpacked
from tidewater.llm.components import components

SIMILAR = 0.93
#: Vectors of a cell on average, the most cells, and the vectors that centroids are
#: fitted on (those with the least digests).
CELL, CELLS, SAMPLE = 2048, 256, 20_000
ROUNDS = 12
#: Vectors of a block's side; angles are taken so much wider or narrower for rounding.
BLOCK, SLACK = 1024, 1e-7

OUT = ("n_links", "component_id", "kept")
_AT = ["__label", "dim", "cell", "core"]


def _units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """(dim, digest, unit) of vectors; null where a vector is null, empty, zero or
    holds null or what isn't finite. Unit vectors are doubles, as bytes."""
    for batch in batches:
        dims, digests, units = [], [], []
        for x in batch:
            v = None if x.as_py() is None or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            most = float(np.abs(v).max(initial=0.0)) if v is not None else 0.0
            good = 0.0 < most < np.inf
            if good:
                v = v / most  # so that no square is lost or infinite
                v = v / np.sqrt(v @ v) + 0.0
            dims.append(len(v) if good else None)
            digests.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if good else None)
            units.append(v.tobytes() if good else None)
        yield pa.StructArray.from_arrays([pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["dim", "digest", "unit"])


def _matrix(units: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = units.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _apart(vectors: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """The first vectors that have no greater cosine than this with any taken before."""
    taken = np.empty((most, vectors.shape[1]))
    n = 0
    for v in vectors:
        if n < most and (taken[:n] @ v).max(initial=-1.0) <= cosine:
            taken[n] = v
            n += 1
    return taken[:n].copy()


def spherical_k_means(vectors: np.ndarray, k: int, similar: float = SIMILAR) -> np.ndarray:
    """At most k unit centroids of unit vectors, none within twice the linking angle of
    another, so that a group of near copies is in one cell."""
    apart = float(np.cos(2 * np.arccos(similar)))
    c = _apart(vectors, k, apart)
    for _ in range(ROUNDS):
        cell = (vectors @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, cell, vectors)
        size = np.sqrt((total * total).sum(1))
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 1e-9]
        new = _apart(total[order] / size[order, None], k, apart)
        if new.shape == c.shape and np.allclose(new, c, atol=1e-12):
            break
        c = new if len(new) else c
    return c


_PLACED = "__label string, dim int, cell int, core boolean, is_left boolean, both boolean, node binary, copies long, unit binary"


def _place(centroids: dict[int, np.ndarray], similar: float):
    """A row for each cell that a vector is in (right) or is compared with (left);
    `both`: the partners found there count the vector too."""
    angle = float(np.arccos(similar))
    within, reach, side = np.cos(angle / 2 - SLACK), np.cos(1.5 * angle + SLACK), np.sin(angle + SLACK)

    def run(batches):
        for batch in small(batches, 4096):
            t = pa.Table.from_batches([batch])
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                u, c = _matrix(t.column("unit").take(own)), centroids.get(d)
                if c is None:  # no vector of so many components in the sample: one cell
                    cos, cell, core = np.zeros((len(own), 1)), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                    gap = np.ones((1, 1))
                else:
                    cos = u @ c.T
                    cell = cos.argmax(1)
                    core = cos[np.arange(len(u)), cell] >= within
                    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
                i = np.arange(len(own))
                best = cos[i, cell]
                # own cell: all with the core if near, outer ones with each other
                near = np.flatnonzero(~core & (best >= reach) & (c is not None))
                parts = [(i, cell, core, False, False), (np.flatnonzero(~core), cell[~core], np.zeros((~core).sum(), bool), True, False), (near, cell[near], np.ones(len(near), bool), True, True)]
                # later cells that a partner may belong to
                may = ((best[:, None] - cos) <= side * gap[cell]) & (np.arange(cos.shape[1]) > cell[:, None])
                for to_core, guests in ((False, may), (True, may & (cos >= reach))):
                    x, to = np.nonzero(guests)
                    parts.append((x, to, np.full(len(x), to_core), True, True))
                for x, to, is_core, left, both in parts:
                    rows = t.take(own[x])
                    n = len(x)
                    yield from pa.table({
                        "__label": rows.column("__label"), "dim": rows.column("dim"), "cell": pa.array(to, pa.int32()), "core": pa.array(is_core, pa.bool_()), "is_left": pa.array(np.full(n, left)),
                        "both": pa.array(np.full(n, both)), "node": rows.column("node"), "copies": rows.column("copies"), "unit": rows.column("unit"),
                    }).to_batches()

    return run


def _connected(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of n is connected with by the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(similar: float):
    """(node, n, other) of each block against another: links counted at node, and links
    that connect what the block's links connect."""

    def run(batches):
        for t in grouped(batches, [*_AT, "left_block", "block"]):
            side = t.column("is_left").to_numpy(zero_copy_only=False)
            left, right = t.filter(pa.array(side)), t.filter(pa.array(~side))
            if not left.num_rows or not right.num_rows:
                continue
            linked = _matrix(left.column("unit")) @ _matrix(right.column("unit")).T >= similar
            names, others = left.column("node").to_pylist(), right.column("node").to_pylist()
            place = {x: k for k, x in enumerate(others)}
            for k, x in enumerate(names):
                if x in place:
                    linked[k, place[x]] = False
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            both = left.column("both").to_numpy(zero_copy_only=False)
            n = np.zeros(len(names) + len(others), np.int64)
            np.add.at(n, i, right.column("copies").to_numpy()[j])
            np.add.at(n, len(names) + j[both[i]], left.column("copies").to_numpy()[i[both[i]]])
            names += others
            root = _connected(i, len(names) - len(others) + j, len(names))
            rows = np.flatnonzero((n > 0) | (root != np.arange(len(names))))
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in rows], pa.binary()), pa.array(n[rows]), pa.array([names[k] for k in root[rows]], pa.binary())], ["node", "n", "other"])

    return run


def _links(nodes: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(counts: node, n; edges: a, b) of the distinct vectors' links."""
    k = max(1, min(CELLS, nodes.count() // CELL))
    sample = nodes.orderBy("node").limit(SAMPLE).select("dim", "unit").toArrow()
    dims = sample.column("dim").to_numpy()
    centroids = {int(d): spherical_k_means(_matrix(sample.column("unit").take(np.flatnonzero(dims == d))), k, similar) for d in np.unique(dims)}
    placed = stored(nodes.select("__label", "dim", "node", "copies", "unit").mapInArrow(_place(centroids, similar), _PLACED), "placed")
    # cores: each member links with all others
    mine = placed.filter("core AND NOT is_left").select(*_AT, "node", "copies")
    cores = stored(mine.groupBy(*_AT).agg(F.sum("copies").alias("total"), F.min("node").alias("first")), "cores")
    inner = join_small(mine, cores, _AT, "inner").select("node", (F.col("total") - F.col("copies")).alias("n"), F.col("first").alias("other"))
    # the others: blocks of what is compared with a cell's part, against blocks of that part
    sizes = placed.groupBy(*_AT).agg(F.count_if(F.col("is_left")).alias("n_left"), F.count_if(~F.col("is_left")).alias("n_right")).filter("n_left > 0 AND n_right > 0")
    sizes = stored(sizes, "sizes")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = join_small(placed, sizes, _AT, "inner").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_left"), blocks("n_left")).otherwise(blocks("n_right"))).cast("int"))
    dealt = dealt.withColumn("across", F.explode(F.sequence(F.lit(0), F.when(F.col("is_left"), blocks("n_right")).otherwise(blocks("n_left")) - 1)))
    pick = lambda x, y: F.when(F.col("is_left"), F.col(x)).otherwise(F.col(y))
    dealt = dealt.select(*_AT, pick("own", "across").alias("left_block"), pick("across", "own").alias("block"), "is_left", "both", "node", "copies", "unit")
    keys = [*_AT, "left_block", "block"]
    outer = stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(similar), "node binary, n long, other binary"), "found")
    inner = stored(inner, "inner")
    discard(placed)
    found = outer.union(inner)
    return found.groupBy("node").agg(F.sum("n").alias("n")), found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))


def link_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", similar: float = SIMILAR) -> DataFrame:
    """vectors with n_links: how many other rows of the same label have a cosine of at
    least `similar` (between 0.5 and 1), in double precision; component_id: the least id
    that links reach, itself included; kept: the id is its component's, so that one row
    of each group stays.

    A null label, and a vector that is null, empty, zero or holds null or non-finite
    components, link with nothing; vectors of different lengths don't link. Repeated rows
    link with each other. A null id gives no component its id: a row that is alone with
    it is kept and has a null component. Exact copies are one vector that counts as many.
    Centroids are fitted on SAMPLE vectors; links don't depend on them. Input columns of
    the names of the new ones are replaced. No rows: no rows."""
    rows = packed(vectors, OUT, __id=F.col(vec_id), __label=F.col(label).cast("string"), __v=F.col(embedding))
    known = rows.withColumn("__u", F.arrow_udf(_units, "dim int, digest binary, unit binary")("__v")).drop("__v")
    node = F.unhex(F.md5(F.concat(F.col("__label").cast("binary"), F.lit(":").cast("binary"), F.col("__u.digest"))))
    known = known.withColumn("node", F.when(F.col("__label").isNotNull(), node))
    good = known.filter("node IS NOT NULL")
    nodes = good.groupBy("__label", F.col("__u.dim").alias("dim"), "node").agg(F.count(F.lit(1)).alias("copies"), F.min("__id").alias("least"), F.first("__u.unit").alias("unit"))
    nodes = stored(nodes, "nodes")
    counts, edges = _links(nodes, similar)
    roots = stored(components(edges), "roots")
    each = nodes.select("node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = stored(each, "each")
    by_root = stored(each.groupBy("root").agg(F.min("least").alias("component_id")), "by-root")
    each = stored(each.join(by_root, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "each")
    alone = known.filter("node IS NULL").select("__in", "__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = good.join(each, "node").select("__in", "__id", "n_links", "component_id").union(alone)
    return unpacked(out.withColumn("kept", F.col("__id").eqNullSafe(F.col("component_id"))), vectors, OUT)


def op13(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", F.col("component_id").cast("long"), "kept")


#: All pairs of equal labels, and the least id by walking the links.
OP13_SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT r, r AS t FROM v UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.t),
m AS (SELECT c.r, min(y.vec_id) AS component_id FROM c JOIN v y ON y.r = c.t GROUP BY c.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)
"""
