"""Suffix arrays by Larsson-Sadakane refinement, and common prefixes by Kasai,
in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that the first sort looks at.
FIRST = 8


def _words(s: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number, 0 after the end."""
    padded = np.concatenate((s, np.zeros(8, np.uint8)))
    out = padded[: len(s)].astype(np.uint64)
    for j in range(1, 8):
        out = (out << np.uint64(8)) | padded[j : j + len(s)]
    return out


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of s by their first `depth` bytes or more;
    those that are equal so far share a rank, the place of the first of them.

    Sorted by eight bytes first; then, as the suffix h bytes on is ranked by h
    bytes already, each step sorts the groups that are not yet single by that rank
    and so doubles h. Groups that are single are never touched again."""
    return refined(_words(s), FIRST, depth)


def refined(key: np.ndarray, h: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """As suffix_array(), from keys that order the suffixes by their first h elements."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    # places in the order that are in groups of several
    size = np.diff(np.append(start, n))
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while h < depth and len(open_):
        at = order[open_]
        after = at + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[open_] = at
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        rank[at] = np.repeat(open_[start], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """For each place in an order and ranks of suffix_array(s, depth), the bytes
    that its suffix and the one before have in common, up to `depth`.

    Kasai's bound: a suffix has in common with its neighbour at least one byte
    less than the suffix one position earlier has with its own. Positions are
    taken in eight rounds, every eighth one at a time, each round starting from
    the bound that the last one gives. Suffixes of one rank are equal so far and
    in any order: those but the first have `depth` bytes in common with the one
    before, and give the next position no bound."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = rank == place
    length = np.where(first, 0, depth)
    padded = np.concatenate((s, np.zeros(1, np.uint8)))
    for r in range(8):
        p = np.arange(r, n, 8)
        p = p[first[p] & (before[p] >= 0)]
        q = before[p]
        known = np.where(first[p - 1], np.maximum(length[p - 1] - 1, 0), 0) if r else np.zeros(len(p), np.int64)
        at = np.arange(len(p))
        while len(at):
            a, b = p[at] + known[at], q[at] + known[at]
            go = (a < n) & (b < n) & (known[at] < depth)
            go[go] = padded[a[go]] == padded[b[go]]
            at = at[go]
            known[at] += 1
        length[p] = known
    out = length[order]
    out[:1] = 0
    return out


def longest_starts(s: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, group) of the k-byte strings at the given starts, in order of
    suffix; equal strings, which have k bytes in common with their neighbours,
    are in one group. Groups number from 0 in the order of their strings."""
    order, rank = suffix_array(s, k)
    group = np.cumsum(common_prefixes(s, order, rank, k) < k)
    wanted = np.zeros(len(s), bool)
    wanted[starts] = True
    keep = wanted[order]
    found = group[keep]
    if not len(found):
        return order[keep], found
    return order[keep], np.cumsum(np.concatenate(([0], (found[1:] != found[:-1]).astype(np.int64))))
