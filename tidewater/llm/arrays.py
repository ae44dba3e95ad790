"""SQL for long arrays and texts, in time that grows with their length only.

A fold that appends to an array copies the array each time; scans here append to
blocks of bounded length. A substring is counted from the text's beginning; texts
here are cut into blocks first."""

from __future__ import annotations

#: Elements of a block of an array, code points of a block of a text.
ELEMENTS, CHARS = 256, 2048


def let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def in_blocks(array: str) -> str:
    """The array's elements in arrays of ELEMENTS."""
    return let("bl", array, f"transform(CASE WHEN size(bl) > 0 THEN sequence(0, (size(bl) - 1) DIV {ELEMENTS}) ELSE CAST(array() AS array<int>) END, i -> slice(bl, i * {ELEMENTS} + 1, {ELEMENTS}))")


def scan(array: str, carry: str, after: str, out: str, kind: str, kept: str = "true") -> str:
    """An array of what `out` gives for each element x of `array`, of SQL type
    `kind`, if `kept` holds; c is what the elements before left: `carry` at first,
    and `after` (of c and x) behind each."""
    none = f"CAST(array() AS array<{kind}>)"
    more = f"concat(a.o, array({out}))" if kept == "true" else f"CASE WHEN {kept} THEN concat(a.o, array({out})) ELSE a.o END"
    # c stands for a.c
    step = let("c", "a.c", f"named_struct('c', {after}, 'o', {more})")
    inner = f"aggregate(b, named_struct('c', w.c, 'o', {none}), (a, x) -> {step})"
    outer = let("r", inner, "named_struct('c', r.c, 'o', concat(w.o, array(r.o)))")
    return f"flatten(aggregate({in_blocks(array)}, named_struct('c', {carry}, 'o', CAST(array() AS array<array<{kind}>>)), (w, b) -> {outer}).o)"


def text_blocks(text: str) -> str:
    """The text in parts of CHARS code points."""
    return f"regexp_extract_all({text}, '(?s).{{1,{CHARS}}}', 0)"


def cut(blocks: str, start: str, end: str) -> str:
    """The code points from start to end (exclusive, counted from 0) of a text in
    blocks."""
    part = f"substr({blocks}[CAST(k AS INT)], CAST(greatest({start} - k * {CHARS}, 0) + 1 AS INT), CAST(least({end} - k * {CHARS}, {CHARS}) - greatest({start} - k * {CHARS}, 0) AS INT))"
    return f"CASE WHEN {end} > {start} THEN array_join(transform(sequence(CAST({start} AS BIGINT) DIV {CHARS}, (CAST({end} AS BIGINT) - 1) DIV {CHARS}), k -> {part}), '') ELSE '' END"
