"""Gradient-boosted trees on a bounded sample, compiled to a SQL expression."""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, reg: float):
    """The best (gain, feature, threshold) of one node."""
    best = (1e-9, None, None)
    total = g.sum() ** 2 / (h.sum() + reg)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v = x[order, j]
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        gl, hl = np.cumsum(g[order])[at], np.cumsum(h[order])[at]
        gain = gl**2 / (hl + reg) + (g.sum() - gl) ** 2 / (h.sum() - hl + reg) - total
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(v[at[k]]))
    return best


def _grow(x, g, h, depth, reg, rate):
    gain, j, t = _split(x, g, h, reg) if depth and len(x) > 1 else (0, None, None)
    if j is None:
        return round(float(-rate * g.sum() / (h.sum() + reg)), 6)
    left = x[:, j] <= t
    return (j, t, _grow(x[left], g[left], h[left], depth - 1, reg, rate), _grow(x[~left], g[~left], h[~left], depth - 1, reg, rate))


def _leaf(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, t, a, b = tree
    return np.where(x[:, j] <= t, _leaf(a, x), _leaf(b, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, reg: float = 1.0) -> list:
    """Trees for the log-odds of y, by Newton steps on the logistic loss."""
    score, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p) + 1e-9, depth, reg, rate)
        out.append(tree)
        score += _leaf(tree, x)
    return out


def margin(trees: list, x: np.ndarray) -> np.ndarray:
    return sum((_leaf(t, x) for t in trees), np.zeros(len(x)))


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's a, b: P(y) = 1 / (1 + exp(-(a score + b))), on held-out rows."""
    a, b = 1.0, 0.0
    up, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    goal = np.where(y > 0, up, low)
    m = np.stack([score, np.ones(len(score))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        grad, w = m @ (p - goal), p * (1 - p) + 1e-9
        da, db = np.linalg.solve((m * w) @ m.T + 1e-6 * np.eye(2), grad)
        a, b = a - da, b - db
    return float(round(a, 6)), float(round(b, 6))


def to_sql(trees: list, names: list[str]) -> str:
    """The margin as a sum of nested CASEs over the features' SQL names."""

    def node(t) -> str:
        if not isinstance(t, tuple):
            return f"{t!r}D" if t >= 0 else f"({t!r}D)"
        return f"CASE WHEN {names[t[0]]} <= {t[1]!r}D THEN {node(t[2])} ELSE {node(t[3])} END"

    return "(" + (" + ".join(node(t) for t in trees) or "0D") + ")"
