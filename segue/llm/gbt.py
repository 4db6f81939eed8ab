"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints.

A fitted model is flat node arrays, so all trees score all rows by `depth` rounds of indexing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    base: float
    depth: int
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        if not len(x) or not len(self.roots):
            return np.full(len(x), self.base)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):  # a leaf points to itself
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 10, bins: int = 48, l2: float = 1.0) -> Trees:
    """monotone: for a feature, 1 if the score may only rise with it, -1 if only fall. One class or no rows: a constant."""
    n, d = x.shape if x.ndim == 2 else (0, 0)
    rate_of = (y.sum() + 1) / (n + 2)
    model = Trees(float(np.log(rate_of / (1 - rate_of))), depth)
    if n == 0 or y.min() == y.max():
        return model
    sign = np.zeros(d, int)
    for f, s in (monotone or {}).items():
        sign[f] = s
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin <= k: value <= cuts[k]
    flat = binned + np.arange(d) * bins
    margin = np.full(n, model.base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        at = len(nodes)
        weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), lo, hi))
        nodes.append([0, 0.0, at, at, rate * weight])
        if level == depth or len(rows) < 2 * least:
            margin[rows] += rate * weight
            return at
        where = flat[rows].ravel()
        tile = lambda v: np.bincount(where, np.repeat(v, d), d * bins).reshape(d, bins).cumsum(axis=1)
        gl, hl, cl = tile(g[rows]), tile(h[rows]), tile(np.ones(len(rows)))
        gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
        wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gt - gl) / (ht - hl + l2), lo, hi)
        score = lambda gg, hh, w: -(gg * w + 0.5 * (hh + l2) * w * w)
        gain = score(gl, hl, wl) + score(gt - gl, ht - hl, wr) - score(gt, ht, weight)
        ok = (cl >= least) & (ct - cl >= least) & (sign[:, None] * (wr - wl) >= 0)
        gain = np.where(ok, gain, -np.inf)
        f, k = divmod(int(np.argmax(gain)), bins)
        if gain[f, k] <= 1e-6 or k >= len(cuts[f]):
            margin[rows] += rate * weight
            return at
        mid = (wl[f, k] + wr[f, k]) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[int(sign[f])]
        goes = binned[rows, f] <= k
        nodes[at][:2] = [f, float(cuts[f][k])]
        nodes[at][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
        nodes[at][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -8.0, 8.0))
    model.roots = np.array(roots, np.int32)
    for k, name in enumerate(("feature", "threshold", "left", "right", "value")):
        setattr(model, name, np.array([v[k] for v in nodes], np.float64 if name in ("threshold", "value") else np.int32))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability), both ascending, by pooling adjacent violators; smoothed by one pseudo-row of each class."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    base = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.0
    x = np.array([b[2] / b[1] for b in blocks])
    p = np.array([(b[0] + base) / (b[1] + 1) for b in blocks])
    return x, np.maximum.accumulate(p) if len(p) else p


def calibrated(points: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    x, p = points
    return np.interp(score, x, p) if len(x) else score
