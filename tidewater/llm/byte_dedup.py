"""Removal of long byte strings that an earlier document has.

A string of 50 bytes is filed under the least hash of its 18-byte parts, so equal
strings are filed alike, and neighbouring strings mostly under the same hash: a
stretch of them (its strings share a hash) is shipped as one piece.

1. Documents are dealt into blocks. Each block sends its hashes to shards, which
   answer which hashes several documents have.
2. For these, each block sends its stretches to shards by hash. A shard builds the
   suffix array of its distinct stretches, in runs of bounded size; Kasai's common
   prefixes group equal strings; the runs' groups are merged by binary search. It
   answers which strings an earlier document has.
3. Each block removes the bytes that these cover.

A shard's stretches are more than one suffix array takes (ARRAY_BYTES), so that runs
are merged in every shard of usual size. Hashes that very many documents have would
fill a shard; their strings are sent one by one, to shards by a hash of the string
itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import stored, table, without
from tidewater.llm.suffix_array import longest_starts

LENGTH = 50
#: Bytes of a part; LENGTH - PART + 1 parts make a string.
PART = 18
#: Text of a block, hashes of a shard, stretches of a shard and of a suffix array.
BLOCK_BYTES, HASH_BYTES, SHARD_BYTES, ARRAY_BYTES = 4 << 20, 4 << 20, 1 << 20, 1 << 18
#: Blocks or shards of one task: more partitions than Spark's setting where the
#: setting would give a task more.
PER_TASK = 32
#: Bytes that are hashed at a time.
CHUNK = 1 << 19
#: A hash that more stretches have than this is sent string by string.
MANY = 4096
LAST = 2**63 - 1
OUT = ("n_bytes", "n_removed", "n_spans", "spans", "kept")

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = (a * _P2) ^ (b + _P3)
    v = (v ^ (v >> np.uint64(29))) * _P1
    return v ^ (v >> np.uint64(32))


def filed_under(data: np.ndarray) -> np.ndarray:
    """For each string of 50 bytes, the hash that it is filed under."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64)
    h = (data.astype(np.uint64) + np.uint64(1)) * _P1
    two = h = _joined(h[:-1], h[1:])
    for k in (2, 4, 8):
        h = _joined(h[:-k], h[k:])
    h = _joined(h[:-2], two[16:])
    for k in (1, 2, 4, 8, 16):
        h = np.minimum(h[:-k], h[k:])
    return np.minimum(h[:-1], h[1:])


class _Block:
    """The documents of a block in a fixed order, and its stretches: runs of
    strings of one document that are filed under one hash."""

    def __init__(self, t: pa.Table):
        keys = t.column("order").to_pylist()
        texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in t.column("text")]
        self.rows = sorted(range(len(keys)), key=lambda i: (keys[i], xxhash.xxh64_intdigest(texts[i])))
        self.keys = np.array([keys[i] for i in self.rows], np.int64)
        self.text = b"".join(texts[i] for i in self.rows)
        sizes = np.array([len(texts[i]) for i in self.rows], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        data, parts = np.frombuffer(self.text, np.uint8), []
        for at in range(0, len(data), CHUNK):
            f = filed_under(data[at : at + CHUNK + LENGTH - 1])
            if not len(f):
                continue
            # strings that cross into the next document count for nothing
            doc = np.searchsorted(self.ends, np.arange(at, at + len(f)), "right")
            valid = np.arange(at, at + len(f)) + LENGTH <= self.ends[doc]
            new = np.concatenate(([True], (f[1:] != f[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1])) & valid
            first = np.flatnonzero(new)
            upto = np.cumsum(valid)
            count = np.diff(np.append(upto[first] - 1, upto[-1]))
            parts.append((f[first], first + at, count, doc[first]))
        c = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        self.filed, self.start, self.count, self.doc = c

    def hashes(self, shards: int):
        """(distinct hashes by shard; how many stretches each has, 1 if all are in
        one document, 255 if more; where each shard's begin)."""
        by = np.argsort(self.filed)
        h, doc = self.filed[by], self.doc[by]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
        if not len(at):
            return h, np.zeros(0, np.uint8), np.zeros(shards + 1, np.int64)
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
        n = np.where(several, np.minimum(np.diff(np.append(at, len(h))), 255), 1).astype(np.uint8)
        h = h[at]
        shard = (h >> np.uint64(7)) % np.uint64(shards)
        by = np.argsort(shard, kind="stable")
        return h[by], n[by], np.searchsorted(shard[by], np.arange(shards + 1, dtype=np.uint64))

    def flagged(self, flags: dict[int, bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes that several documents have, in order, and which of them
        very many have."""
        h, _, at = self.hashes(shards)
        flag = np.zeros(len(h), np.uint8)
        for s, x in flags.items():
            flag[at[s] : at[s + 1]] = np.frombuffer(x, np.uint8)
        some, flag = h[flag > 0], flag[flag > 0]
        by = np.argsort(some)
        return some[by], flag[by] > 1

    def pieces(self, some: np.ndarray, many: np.ndarray, shards: int):
        """The distinct byte strings of the block's flagged stretches, and their
        uses: a _Pieces."""
        where = np.minimum(np.searchsorted(some, self.filed), max(0, len(some) - 1))
        hit = np.flatnonzero(some[where] == self.filed) if len(some) else np.zeros(0, np.int64)
        start, count, doc, value, whole = self.start[hit], self.count[hit], self.doc[hit], self.filed[hit], ~many[where[hit]] if len(some) else np.zeros(0, bool)
        # strings of very common hashes one by one
        times = np.where(whole, 1, count)
        start = np.repeat(start - (np.cumsum(times) - times), times) + np.arange(times.sum())
        start = np.where(np.repeat(whole, times), np.repeat(self.start[hit], times), start)
        count, doc, value, whole = np.repeat(np.where(whole, count, 1), times), np.repeat(doc, times), np.repeat(value, times), np.repeat(whole, times)
        found: dict[bytes, int] = {}
        text = self.text
        place = np.fromiter((found.setdefault(text[a : a + n], len(found)) for a, n in zip(start.tolist(), (count + LENGTH - 1).tolist())), np.int64, len(start))
        first = np.full(len(found), len(start), np.int64)
        np.minimum.at(first, place, np.arange(len(start)))
        shard = ((value[first] >> np.uint64(9)) % np.uint64(shards)).astype(np.int64)
        names = list(found)
        for i in np.flatnonzero(~whole[first]).tolist():
            shard[i] = xxhash.xxh64_intdigest(names[i]) % shards
        return _Pieces(names, shard, self.keys[doc[first]], start, count, self.keys[doc], place, shards)


class _Pieces:
    """least: the least key of a document with the piece; order: pieces by shard;
    at: where each shard's begin in it; begin: each piece's first string, counted
    in this order."""

    def __init__(self, names, shard, least, start, count, key, place, shards):
        self.names, self.least, self.start, self.count, self.key, self.place = names, least, start, count, key, place
        self.order = np.argsort(shard, kind="stable")
        self.at = np.searchsorted(shard[self.order], np.arange(shards + 1))
        self.strings = np.array([len(x) for x in names], np.int64) - LENGTH + 1
        n = self.strings[self.order]
        self.begin = np.empty(len(names), np.int64)
        self.begin[self.order] = np.cumsum(n) - n


def _table(rows: list[tuple], **kinds) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)})


def _hash_rows(shards: int):
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        h, n, at = _Block(t).hashes(shards)
        rows = [(block, s, h[at[s] : at[s + 1]].tobytes(), n[at[s] : at[s + 1]].tobytes()) for s in np.flatnonzero(np.diff(at)).tolist()]
        return _table(rows, block=pa.int64(), shard=pa.int64(), data=pa.binary(), counts=pa.binary())

    return run


def _flag_rows(t: pa.Table) -> pa.Table:
    """For each block's hashes: 0 if one document has it, 2 if very many, else 1."""
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("data")]
    h = np.concatenate(parts)
    count = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("counts")]).astype(np.int64)
    by = np.argsort(h)
    start = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    total = np.add.reduceat(count[by], start)
    flag = np.empty(len(h), np.uint8)
    flag[by] = np.repeat((total > 1).astype(np.uint8) + (total > MANY).astype(np.uint8), np.diff(np.append(start, len(h))))
    cut = np.split(flag, np.cumsum([len(x) for x in parts])[:-1])
    rows = [(b, s, x.tobytes(), int((x > 0).sum())) for b, s, x in zip(t.column("block").to_pylist(), t.column("shard").to_pylist(), cut) if x.any()]
    return _table(rows, block=pa.int64(), shard=pa.int64(), data=pa.binary(), n=pa.int64())


def _answers(t: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: x for k, s, x in zip(t.column("kind").to_pylist(), t.column("shard").to_pylist(), t.column("data").to_pylist()) if k == kind}


def _piece_rows(hash_shards: int, shards: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows and answers.num_rows:
            block = _Block(t)
            x = block.pieces(*block.flagged(_answers(answers, 0), hash_shards), shards)
            number = t.column("block")[0].as_py()
            for s in np.flatnonzero(np.diff(x.at)).tolist():
                own = x.order[x.at[s] : x.at[s + 1]]
                rows.append((number, s, b"".join([x.names[i] for i in own.tolist()]), (x.strings[own] + LENGTH - 1).astype(np.int32).tobytes(), x.least[own].tobytes()))
        return _table(rows, block=pa.int64(), shard=pa.int64(), data=pa.binary(), lengths=pa.binary(), least=pa.binary())

    return run


def _strings(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Strings of 50 bytes as numpy ones; a closing byte keeps zeros at the end."""
    out = np.ones((len(starts), LENGTH + 1), np.uint8)
    for j in range(LENGTH):
        out[:, j] = s[starts + j]
    return np.ascontiguousarray(out).view(f"S{LENGTH + 1}").ravel()


def earliest(pieces: list[bytes], least: np.ndarray) -> np.ndarray:
    """For each string of 50 bytes of each piece in turn, the least key of a piece
    that holds it. Pieces are taken in runs of ARRAY_BYTES; each run's suffix array
    gives its distinct strings in order, with their least keys. The runs' lists
    are merged one after another, and each run's strings are then looked up in
    the merged list by binary search."""
    heads, best, runs, i = np.zeros(0, f"S{LENGTH + 1}"), np.zeros(0, np.int64), [], 0
    while i < len(pieces):
        j, total = i, 0
        while j < len(pieces) and (j == i or total + len(pieces[j]) <= ARRAY_BYTES):
            total += len(pieces[j])
            j += 1
        s = np.frombuffer(b"".join(pieces[i:j]), np.uint8)
        lengths = np.array([len(x) for x in pieces[i:j]])
        count = lengths - LENGTH + 1
        first = np.cumsum(lengths) - lengths
        starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at, group = longest_starts(s, starts, LENGTH)
        key = np.empty(len(s), np.int64)
        key[starts] = np.repeat(least[i:j], count)
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        low = np.minimum.reduceat(key[at], begin)
        names = _strings(s, at[begin])
        # where each string stands among all: in text order
        place = np.empty(len(s), np.int64)
        place[at] = group
        runs.append((names, place[starts]))
        if len(heads):
            to = np.searchsorted(heads, names)
            old = heads[np.minimum(to, len(heads) - 1)] == names
            np.minimum.at(best, to[old], low[old])
            heads, best = np.insert(heads, to[~old], names[~old]), np.insert(best, to[~old], low[~old])
        else:
            heads, best = names, low
        i = j
    out = [best[np.searchsorted(heads, names)][place] for names, place in runs]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _earlier_rows(t: pa.Table) -> pa.Table:
    """For each block's pieces, a bit for each string: whether a document before
    the block's first with that piece has it."""
    known: dict[bytes, int] = {}
    least: list[int] = []
    blocks = []
    for data, lengths, keys in zip(t.column("data"), t.column("lengths"), t.column("least")):
        data, lengths, keys = data.as_py(), np.frombuffer(lengths.as_py(), np.int32).astype(np.int64), np.frombuffer(keys.as_py(), np.int64)
        at, own = 0, []
        for n, key in zip(lengths.tolist(), keys.tolist()):
            place = known.setdefault(data[at : at + n], len(least))
            if place == len(least):
                least.append(key)
            elif key < least[place]:
                least[place] = key
            own.append(place)
            at += n
        blocks.append((np.array(own, np.int64), lengths - LENGTH + 1, keys))
    pieces = list(known)
    first = earliest(pieces, np.array(least, np.int64))
    count = np.array([len(x) - LENGTH + 1 for x in pieces], np.int64)
    begin = np.cumsum(count) - count
    out = []
    for own, n, keys in blocks:
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(np.packbits(first[at] < np.repeat(keys, n)).tobytes())
    return pa.table({"block": t.column("block").combine_chunks(), "shard": t.column("shard").combine_chunks(), "data": pa.array(out, pa.binary())})


def spans_of(covered: np.ndarray) -> np.ndarray:
    """(start, end) of each run of true values."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removed_rows(hash_shards: int, shards: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"row": pa.array([], t.schema.field("row").type), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary())})
        block = _Block(t)
        starts = np.zeros(len(block.text) + 1, np.int32)
        if answers.num_rows:
            x = block.pieces(*block.flagged(_answers(answers, 0), hash_shards), shards)
            earlier = np.zeros(int(x.strings.sum()), bool)
            for s, bits in _answers(answers, 1).items():
                own = x.order[x.at[s] : x.at[s + 1]]
                n, a = int(x.strings[own].sum()), int(x.begin[own[0]])
                earlier[a : a + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
            # every string of every stretch
            n = x.count
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = earlier[np.repeat(x.begin[x.place], n) + step]
            # of equal pieces in a block, all but the first document's have it from there
            hit |= np.repeat(x.key > x.least[x.place], n)
            starts[(np.repeat(x.start, n) + step)[hit]] = 1
        upto = np.concatenate((np.zeros(LENGTH, np.int32), np.cumsum(starts[:-1], dtype=np.int32)))
        covered = upto[LENGTH:] > upto[:-LENGTH]
        spans, kept = [], []
        for a, b in zip(block.begins.tolist(), block.ends.tolist()):
            found = spans_of(covered[a:b]).tolist() if covered[a:b].any() else []
            left, at = [], a
            for x, y in found:
                left.append(block.text[at : a + x])
                at = a + y
            left.append(block.text[at:b])
            spans.append([{"start": x, "end": y} for x, y in found])
            kept.append(b"".join(left))
        rows = t.column("row").combine_chunks().take(pa.array(block.rows, pa.int64()))
        return pa.table({"row": rows, "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})

    return run


def _dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """df dealt by key to tasks of at most about PER_TASK groups."""
    n = math.ceil(groups / PER_TASK)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of docs with n_bytes, n_removed, n_spans (long), spans (start and
    end of each maximal removed run, in bytes, end exclusive) and kept (the other
    bytes, as binary); input columns of these names are replaced.

    Each byte of a text (in UTF-8) goes that is covered by a string of 50 bytes
    which also starts in a document with a smaller doc_id; strings are judged on
    the input and don't cross documents. Null text: empty. Null doc_id: after all
    others, so nothing is removed for its sake. Rows with equal doc_id don't
    remove from one another. Texts under 50 bytes lose nothing. Very long texts are
    taken whole, each by one task. No rows: no rows.
    """
    docs = without(docs, *OUT)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string")).cast("long")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    # a text has about one hash for 17 bytes
    hash_shards = max(1, math.ceil(size / 17 * 8 / HASH_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    rows = rows.select(F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(blocks)).alias("block"), F.coalesce("id", F.lit(LAST)).alias("order"), "text", "row")
    slim = _dealt(rows.select("block", "order", "text"), "block", blocks)
    hashes = slim.groupBy("block").applyInArrow(_hash_rows(hash_shards), "block long, shard long, data binary, counts binary")
    flags = stored(_dealt(hashes, "shard", hash_shards).groupBy("shard").applyInArrow(_flag_rows, "block long, shard long, data binary, n long"), "flags")
    n = flags.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(n * (LENGTH + 17) / SHARD_BYTES))
    first = flags.select("block", F.lit(0).alias("kind"), "shard", "data")
    both = lambda x, y: _dealt(x, "block", blocks).groupBy("block").cogroup(_dealt(y, "block", blocks).groupBy("block"))
    pieces = both(rows, first).applyInArrow(_piece_rows(hash_shards, shards), "block long, shard long, data binary, lengths binary, least binary")
    earlier = _dealt(pieces, "shard", shards).groupBy("shard").applyInArrow(_earlier_rows, "block long, shard long, data binary")
    answers = first.unionByName(earlier.select("block", F.lit(1).alias("kind"), "shard", "data"))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = both(rows, answers).applyInArrow(_removed_rows(hash_shards, shards), T.StructType([rows.schema["row"], T.StructField("spans", spans), T.StructField("kept", T.BinaryType())]))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text],
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept",
    )


def op7(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
