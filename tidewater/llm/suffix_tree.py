"""Maximal runs of repeated words by a suffix tree, in numpy.

The tree is that of many word sequences at once, each between separators of its own.
Its inner nodes are the intervals of the suffix array; a node with several children
stands as a chain of nodes of equal depth with two sides each. Stoye and Gusfield
(2002): if a node of depth d has the leaves i and i + d on different sides, the d words
at i and those at i + d are a repeat that its next word breaks, a branching tandem
repeat. Each node asks only for the leaves of its smaller side, n log n in all. Every
other tandem repeat is a rotation of a branching one to the left: rotating until a
word differs, and merging repeats that end alike, gives the maximal runs."""

from __future__ import annotations

import numpy as np

from tidewater.llm.suffix_array import refined

#: Steps that comparisons take side by side before the longer ones are taken by slices,
#: leaves that a step looks at, and pointers that are followed one at a time.
SIDE, LEAVES, FEW = 64, 1 << 20, 64


def matching(w: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many elements from each a on equal those from b on; with `back`, up to them.
    Separators end every comparison inside w."""
    sign = -1 if back else 1
    out, at = np.zeros(len(a), np.int64), np.arange(len(a))
    for _ in range(SIDE):
        at = at[w[a[at] + sign * out[at]] == w[b[at] + sign * out[at]]]
        if not len(at):
            return out
        out[at] += 1
    for i in at.tolist():
        x, y, done, size = int(a[i]), int(b[i]), int(out[i]), SIDE
        while True:
            u, v = (w[max(p - done - size + 1, 0) : p - done + 1][::-1] if back else w[p + done : p + done + size] for p in (x, y))
            n = min(len(u), len(v))
            differ = u[:n] != v[:n]
            first = int(differ.argmax()) if n else 0
            if n and differ[first]:
                done += first
                break
            done, size = done + n, min(2 * size, 1 << 16)
        out[i] = done
    return out


def suffix_order(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of w, whose last element occurs once."""
    bits = int(w.max(initial=0) + 1).bit_length()
    key, h = np.zeros(len(w), np.uint64), 63 // bits
    for j in range(h):
        nxt = np.zeros(len(w), np.uint64)
        nxt[: max(len(w) - j, 0)] = w[j:] + 1
        key = (key << np.uint64(bits)) | nxt
    return refined(key, h, len(w))


def common_prefixes(w: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Elements that each suffix in order has in common with the one before. Where the
    elements before two neighbours are equal too, it is one less than at the position
    before; the others are compared, n log n elements in all (Karkkainen et al., 2009)."""
    n = len(w)
    i, before = np.arange(n), np.full(n, -1)
    before[order[1:]] = order[:-1]
    fixed = (before <= 0) | (i == 0)
    fixed |= w[i - 1] != w[before - 1]
    length = np.zeros(n, np.int64)
    own = np.flatnonzero(fixed & (before >= 0))
    length[own] = matching(w, own, before[own])
    last = np.maximum.accumulate(np.where(fixed, i, 0))
    return (length[last] - (i - last))[order]


def _smaller_before(v: np.ndarray, or_equal: bool) -> np.ndarray:
    """The last place before each one of positive value whose value is smaller (or
    equal); v[0] is below all others. What stands between is passed by its own pointers,
    all at once, the last few pointers one at a time."""
    to = np.maximum(np.arange(len(v)) - 1, 0)
    above = (lambda p, k: v[p] > v[k]) if or_equal else (lambda p, k: v[p] >= v[k])
    at = np.flatnonzero(v > 0)
    at = at[above(to[at], at)]
    while len(at) > FEW:
        to[at] = to[to[at]]
        at = at[above(to[at], at)]
    for k in at.tolist():
        p, own = int(to[k]), v[k]
        while v[p] > own or (v[p] == own and not or_equal):
            p = int(to[p])
        to[k] = p
    return to


def branching_repeats(w: np.ndarray, order: np.ndarray, rank: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats with periods up to `longest`."""
    n = len(w)
    depth = common_prefixes(w, order)
    # node k parts the suffixes at places left..k-1 from those at k..right-1
    padded = np.concatenate(([-1], depth[1:]))
    left = _smaller_before(padded, False)
    right = n - np.roll(_smaller_before(np.concatenate(([-1], padded[:0:-1])), True)[::-1], 1)
    node = np.flatnonzero((depth > 0) & (depth <= longest))
    left, right = left[node], right[node]
    low = node - left <= right - node
    start = np.where(low, left, node)
    size = np.where(low, node - left, right - node)
    other, other_end = np.where(low, node, left), np.where(low, right, node)
    ends, starts, periods = np.cumsum(size), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = int(ends[-1]) if len(ends) else 0
    for t in range(0, total, LEAVES):
        to = min(t + LEAVES, total)
        a, b = int(np.searchsorted(ends, t, "right")), int(np.searchsorted(ends, to, "left"))
        part = np.arange(a, b + 1)
        counts = np.minimum(ends[part], to) - np.maximum(ends[part] - size[part], t)
        k = np.repeat(part, counts)
        leaf = order[start[k] + np.arange(t, to) - (ends[k] - size[k])]
        d = depth[node[k]]
        for sign in (1, -1):
            partner = leaf + sign * d
            inside = (partner >= 0) & (partner < n)
            place = rank[np.where(inside, partner, 0)]
            hit = inside & (place >= other[k]) & (place < other_end[k])
            starts.append(np.minimum(leaf, partner)[hit])
            periods.append(d[hit])
    return np.concatenate(starts), np.concatenate(periods)


def maximal_runs(w: np.ndarray, shortest: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period), by start and period, of all stretches of w of at least
    max(shortest, times * period) elements, times >= 2, that no neighbouring element
    extends; period is the smallest. w begins with, ends in and is parted by separators,
    elements that occur once each."""
    none = np.zeros(0, np.int64)
    if len(w) < shortest:
        return none, none, none
    order, rank = suffix_order(w)
    start, period = branching_repeats(w, order, rank, len(w) // times)
    by = np.lexsort((period, start + 2 * period))
    start, period = start[by], period[by]
    end, found = start + 2 * period, []
    while len(start):
        first = np.concatenate(([True], end[1:] != end[:-1]))
        own, of = np.flatnonzero(first), np.cumsum(first) - 1
        # rotated to the left as long as the word before equals that a period on
        begin = start[own] - matching(w, start[own] - 1, start[own] + period[own] - 1, back=True)
        found.append((begin, end[own] - begin, period[own]))
        # a repeat inside the run whose period is a multiple of the run's is that run
        same = (period % period[own][of] == 0) & (start >= begin[of])
        stay = ~first & ~same
        start, period, end = start[stay], period[stay], end[stay]
    if not found:
        return none, none, none
    begin, length, period = (np.concatenate(x) for x in zip(*found))
    keep = length >= np.maximum(shortest, times * period)
    begin, length, period = begin[keep], length[keep], period[keep]
    by = np.lexsort((period, begin))
    return begin[by], length[by], period[by]
