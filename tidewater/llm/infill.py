"""Fill-in-middle transformation by a parallel automaton scan.

Texts are cut into tokens by an automaton whose events are the tokens' ends. A text is
scanned in chunks of 256 bytes that know nothing of each other; each gives its state
function and counts, and their composition gives the number of tokens and the chunk
that holds a cut. Giant texts are dealt to tasks in pieces: each piece gives its
function, a text's few functions are composed, and only the pieces with a cut are read
again. Text, parts and output stay in Spark's columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.automaton import Automaton, Scan
from tidewater.llm.common import packed, stored, table, unpacked

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42"
#: Hundredths of texts that are transformed, and of those with the suffix first.
SHARE, SUFFIX_FIRST = 50, 80
#: Bytes of a piece of a giant text; shorter texts are scanned where they are.
PIECE = 1 << 16
#: Bytes that one scan takes at a time.
SCAN = 1 << 22

OUT = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")

#: Before or between words, in a gap, in a word; a token ends where a word does, and
#: at the end of the text.
_START, _GAP, _WORD = 0, 1, 2
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
TOKENS = Automaton(np.where(_SPACE, 0, 1), np.array([[_GAP] * 3, [_WORD] * 3]), np.array([[0, 0, 1], [0, 0, 0]]), np.array([0, 1, 1]))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each one's length; null: none."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    if raw.null_count:
        raw = raw.fill_null(b"")
        return _bytes(raw)
    return data[ends[0] : ends[-1]] if len(ends) else data[:0], np.diff(ends)


def _slices(lengths: np.ndarray) -> Iterator[slice]:
    """Neighbouring texts of SCAN bytes together, or one that is longer."""
    at, ends = 0, np.cumsum(lengths)
    while at < len(lengths):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SCAN, "right")))
        yield slice(at, to)
        at = to


def _scans(texts: pa.Array) -> Iterator[tuple[slice, Scan]]:
    data, lengths = _bytes(texts)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    for part in _slices(lengths):
        yield part, Scan(TOKENS, data[ends[part.start] : ends[part.stop]], lengths[part])


def _cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before the first and the second cut."""
    x, y = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(x, y), np.maximum(x, y)


def _cut_here(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Tokens of each text, and the bytes before its cuts."""
    for texts, h1, h2 in batches:
        one, two = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
        out = [np.zeros((0, 3), np.int64)]
        for part, scan in _scans(texts):
            left, count = scan.functions()
            n = count[:, _START] + TOKENS.last[left[:, _START]]
            entry = np.zeros(len(n), np.int64)
            out.append(np.stack([n, *(scan.find(entry, k) for k in _cuts(n, one[part], two[part]))], 1))
        yield pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(out).T.copy()], ["n", "first", "second"])


def _function_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What a piece is left in and emits, by the state that it is entered in."""
    for pieces in batches:
        found = [scan.functions() for _, scan in _scans(pieces)]
        left, events = (np.concatenate([np.zeros((0, TOKENS.states), np.int64), *x]) for x in (([f[0] for f in found]), ([f[1] for f in found])))
        rows = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, TOKENS.states, dtype=np.int32), pa.array(x.ravel()))
        yield pa.StructArray.from_arrays([rows(left), rows(events)], ["left", "events"])


def _find_in(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The byte of a piece before which the event of this number is."""
    for pieces, entry, number in batches:
        state, k = entry.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        yield pa.array(np.concatenate([np.zeros(0, np.int64), *(scan.find(state[part], k[part]) for part, scan in _scans(pieces))]))


_KEY = ("__h1", "__h2", "__hash")
_SELECTED = "n long, " + ", ".join(f"piece{i} long, entry{i} long, number{i} long" for i in (1, 2))


def _select(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
    """Composes a text's pieces, at most 2 GB / PIECE rows, and selects the pieces that
    hold its cuts: their entry states and the events that are left to find."""
    pieces = pieces.sort_by("piece")
    entry, before, state, total = [], [], 0, 0
    for left, events in zip(pieces.column("left").to_pylist(), pieces.column("events").to_pylist()):
        entry.append(state)
        before.append(total)
        state, total = left[state], total + events[state]
    n = total + int(TOKENS.last[state])
    out = {"n": [n]}
    for i, k in enumerate(_cuts(np.array([n]), *(np.array([x.as_py()]) for x in key[:2])), 1):
        at = max(int(np.searchsorted(before, int(k[0]), "left")) - 1, 0)
        out |= {f"piece{i}": [at], f"entry{i}": [entry[at]], f"number{i}": [int(k[0]) - before[at]]}
    return pa.table({name: pa.array([v.as_py()], pa.int64()) for name, v in zip(_KEY, key)} | {k: pa.array(v, pa.int64()) for k, v in out.items()})


def _cut_in_pieces(giants: DataFrame) -> DataFrame:
    """giants with __cut, as _cut_here gives it."""
    raw = F.col("__text").cast("binary")
    size = F.octet_length("__text").cast("long")
    piece = lambda i: F.substring(raw, (i * PIECE + 1).cast("int"), F.lit(PIECE))
    pieces = giants.select(*_KEY, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / PIECE)), lambda i: F.struct(i.alias("piece"), piece(i).alias("bytes")))).alias("p"))
    # a row for each piece goes to any task; equal texts' pieces are one row afterwards
    dealt = pieces.select(*_KEY, "p.piece", "p.bytes").repartition(*_KEY, "piece", F.spark_partition_id())
    each = dealt.select(*_KEY, "piece", F.arrow_udf(_function_of, "left array<long>, events array<long>")("bytes").alias("f")).groupBy(*_KEY, "piece").agg(F.first("f").alias("f")).select(*_KEY, "piece", "f.left", "f.events")
    selected = stored(each.groupBy(*_KEY).applyInArrow(_select, f"{', '.join(f'{k} long' for k in _KEY)}, {_SELECTED}"), "selected")
    found = giants.join(selected.hint("merge"), list(_KEY))
    find_in = F.arrow_udf(_find_in, "long")
    place = lambda i: F.col(f"piece{i}") * PIECE + find_in(piece(F.col(f"piece{i}")), F.col(f"entry{i}"), F.col(f"number{i}"))
    return found.select(*giants.columns, F.struct("n", place(1).alias("first"), place(2).alias("second")).alias("__cut"))


def _group(digest: Column, i: int) -> Column:
    """The i-th group of 8 hexadecimal digits, from 0, as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _behind(text: str, start: str, end: str | None = None) -> str:
    """SQL: what stands behind the first `start` in text, up to the first `end`."""
    to = f"locate('{end}', {text}) - locate('{start}', {text}) - {len(start)}" if end else f"length({text})"
    return f"substring({text}, locate('{start}', {text}) + {len(start)}, {to})"


def restored(form: str, output: str) -> str:
    """SQL: the text that was transformed, by its form and output. A transformed text
    holds no mark, and marks can't overlap text, so each mark's first place is its own."""
    psm = f"concat({_behind(output, PREFIX, SUFFIX)}, {_behind(output, MIDDLE)}, {_behind(output, SUFFIX, MIDDLE)})"
    spm = f"concat({_behind(output, PREFIX, MIDDLE)}, {_behind(output, MIDDLE)}, {_behind(output, SUFFIX, PREFIX)})"
    return f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {output} END"


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: str = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (tokens), form (plain, spm or psm), prefix_chars and middle_chars
    (code points; null if plain), output, and restored: the text as read back from form
    and output. A token is a word with the white space before it, or the white space at
    the end. Two token counts drawn from the id's digest cut a text in prefix, middle
    and suffix; `share` hundredths of the texts are transformed, of which `suffix_first`
    hundredths get the suffix first.

    A text that is empty, or holds a mark, is plain. Null text: as an empty one. Null
    id: the digest of the seed alone. Repeated rows are transformed alike. Very long
    texts are scanned in pieces by many tasks; positions are exact. Input columns of the
    names of the new ones are replaced. No rows: no rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h = [_group(digest, i) for i in range(4)]
    plain = (body == "") | F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE)) | (h[2] % 100 >= share)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = packed(docs, OUT, __text=body, __h1=h[0], __h2=h[1], form=form, __hash=F.xxhash64(body))
    giant = F.octet_length("__text") > PIECE
    cut = rows.filter(~giant).withColumn("__cut", F.arrow_udf(_cut_here, "n long, first long, second long")("__text", "__h1", "__h2")).unionByName(_cut_in_pieces(rows.filter(giant)))
    raw, one, two = F.col("__text").cast("binary"), F.col("__cut.first"), F.col("__cut.second")
    part = lambda start, size: F.substring(raw, (start + 1).cast("int"), size.cast("int")).cast("string")
    cut = cut.withColumns({"n": F.col("__cut.n"), "__p": part(F.lit(0), one), "__m": part(one, two - one), "__s": part(two, F.octet_length("__text") - two)})
    spm, psm = F.concat(F.lit(SUFFIX), "__s", F.lit(PREFIX), "__p", F.lit(MIDDLE), "__m"), F.concat(F.lit(PREFIX), "__p", F.lit(SUFFIX), "__s", F.lit(MIDDLE), "__m")
    cut = cut.withColumn("output", F.when(F.col("form") == "plain", F.col("__text")).when(F.col("form") == "spm", spm).otherwise(psm))
    sizes = {f"{name}_chars": F.when(F.col("form") != "plain", F.length(c).cast("long")) for name, c in (("prefix", "__p"), ("middle", "__m"))}
    return unpacked(cut.withColumns({**sizes, "restored": F.expr(restored("form", "output"))}), docs, OUT)


def op11(spark, sf_dir):
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Tokens as a list; the output by slices of it.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, len(w)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
