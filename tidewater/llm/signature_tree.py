"""Signature trees and their dual traversal."""

from __future__ import annotations

import numpy as np

FANOUT = 8
#: Node pairs that are looked at together, to bound memory.
AT_ONCE = 1 << 14


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """Tokens as a bitmap of `width` bits (a power of two, at least 64): bit h
    mod width for each token h."""
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller width: the same as if made at that width."""
    while len(bits) * 64 > width:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


class SignatureTree:
    """Sets in a hierarchy. A node holds the OR of its sets' bitmaps, the range
    of their sizes, the most tokens that one of them loses to shared bits, and
    the group that all its sets are in, or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray | None = None):
        # sets of like size and like first bits stand together
        self.order = np.lexsort((bits[:, 0], sizes))
        n, b = sizes[self.order].astype(np.int64), bits[self.order]
        slack = n - np.bitwise_count(b).sum(axis=1, dtype=np.int64)
        g = groups[self.order] if groups is not None else np.full(len(n), -1, np.int64)
        self.levels = [(b, n, n, slack, g)]
        while len(n) > 1:
            at = np.arange(0, len(n), FANOUT)
            b = np.bitwise_or.reduceat(b, at, axis=0)
            lo, hi = np.minimum.reduceat(self.levels[-1][1], at), np.maximum.reduceat(self.levels[-1][2], at)
            slack = np.maximum.reduceat(slack, at)
            same = np.minimum.reduceat(g, at) == np.maximum.reduceat(g, at)
            g = np.where(same, g[at], -1)
            n = lo
            self.levels.append((b, lo, hi, slack, g))

    def __len__(self) -> int:
        return len(self.order)


def _possible(x, y, i, j, p: int, q: int) -> np.ndarray:
    """Whether node pairs may hold a pair of sets with q |A & B| >= p |A | B|."""
    bx, lx, hx, sx, gx = (v[i] for v in x)
    by, ly, hy, sy, gy = (v[j] for v in y)
    ok = (q * hx >= p * ly) & (q * hy >= p * lx) & ((gx != gy) | (gx < 0))
    at = np.flatnonzero(ok)
    # |A & B| is at most the bits that both nodes have and the tokens lost to shared bits,
    # and at least p (|A| + |B|) / (p + q)
    most = np.bitwise_count(bx[at] & by[at]).sum(axis=1, dtype=np.int64) + np.minimum(sx[at], sy[at])
    ok[at] = (p + q) * most >= p * (lx[at] + ly[at])
    return ok


def dual_traversal(x: SignatureTree, y: SignatureTree, p: int, q: int):
    """Yields arrays (i, j) of the sets of x and y that may be similar, from the
    roots down: of the children of a pair of nodes that is possible, all pairs.
    If x is y, each pair of different sets once."""
    same = x is y
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        lx, ly, i, j = stack.pop()
        if len(i) > AT_ONCE:
            stack += [(lx, ly, i[k : k + AT_ONCE], j[k : k + AT_ONCE]) for k in range(0, len(i), AT_ONCE)]
            continue
        if same and lx == ly:
            keep = i < j if lx == 0 else i <= j
            i, j = i[keep], j[keep]
        ok = _possible(x.levels[lx], y.levels[ly], i, j, p, q)
        if same and lx == ly and lx:
            ok |= (i == j) & (x.levels[lx][4][i] < 0)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            yield x.order[i], y.order[j]
            continue
        if lx >= ly:
            ci = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            cj = np.repeat(j, FANOUT)
            keep = ci < len(x.levels[lx - 1][1])
            i, j, lx = ci[keep], cj[keep], lx - 1
        if ly > lx or (same and ly > lx):
            cj = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            ci = np.repeat(i, FANOUT)
            keep = cj < len(y.levels[ly - 1][1])
            i, j, ly = ci[keep], cj[keep], ly - 1
        stack.append((lx, ly, i, j))
