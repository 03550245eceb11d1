"""Gradient-boosted trees on a bounded sample, in numpy: histogram splits, logistic loss, monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees, flattened. ``left`` of a leaf is -1; a row goes left where its feature <= threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums all trees for all rows of ``x``; every step moves each (row, tree) one level down."""
        out = np.full(len(x), self.bias)
        if not len(self.roots):
            return out
        for i in range(0, len(x), 8192):
            part = x[i : i + 8192]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                inner = self.left[node] >= 0
                down = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            out[i : i + 8192] += self.value[node].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Fits to labels 0 and 1. ``monotone`` has for each feature -1, 0 or 1: the score may only fall, is free, or may only rise.

    A split on a constrained feature is taken only if its leaves stand in the right order, and what lies below is
    held on its side of the middle between them. No rows give even odds; rows of one class give that class's odds.
    """
    n, m = x.shape
    monotone = np.zeros(m, int) if monotone is None else np.asarray(monotone)
    rate_of_1 = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate_of_1 / (1 - rate_of_1)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for k in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), int)
    margin = np.full(n, bias)

    def leaf(weight: float) -> int:
        feature.append(0), threshold.append(0.0), left.append(-1), right.append(-1), value.append(weight)
        return len(value) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        weigh = lambda a, b: np.clip(-a / (b + ridge), low, high)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(weigh(total_g, total_h))
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + ridge) * w * w)
        best, base = (1e-6, -1, -1), gain_of(total_g, total_h, own)
        if level < depth:
            for k in range(m):
                if not len(cuts[k]):
                    continue
                hist = [np.cumsum(np.bincount(binned[rows, k], weights=v, minlength=len(cuts[k]) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows)))]
                wl, wr = weigh(hist[0], hist[1]), weigh(total_g - hist[0], total_h - hist[1])
                gain = gain_of(hist[0], hist[1], wl) + gain_of(total_g - hist[0], total_h - hist[1], wr) - base
                bad = (hist[2] < least) | (len(rows) - hist[2] < least) | (monotone[k] * (wr - wl) < 0)
                gain[bad] = -np.inf
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
        if best[1] < 0:
            return leaf(rate * own)
        _, k, at = best
        goes = binned[rows, k] <= at
        low_l, high_l, low_r, high_r = low, high, low, high
        if monotone[k]:
            middle = float((weigh(g[rows[goes]].sum(), h[rows[goes]].sum()) + weigh(g[rows[~goes]].sum(), h[rows[~goes]].sum())) / 2)
            if monotone[k] > 0:
                high_l, low_r = middle, middle
            else:
                low_l, high_r = middle, middle
        node = leaf(rate * own)
        feature[node], threshold[node] = k, float(cuts[k][at])
        a = grow(rows[goes], g, h, low_l, high_l, level + 1)
        b = grow(rows[~goes], g, h, low_r, high_r, level + 1)
        left[node], right[node] = a, b
        return node

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), -8.0, 8.0, 0))
            one = Trees(np.array(roots[-1:]), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), 0.0, depth)
            margin += one.margin(x)
    return Trees(np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int), np.array(value), bias, depth)


def paths(trees: Trees) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every way from a root to a node as a rule: (feature, <= or >, threshold) parts, duplicates dropped."""
    found: dict[tuple, None] = {}

    def walk(node: int, rule: dict[tuple[int, bool], float]) -> None:
        if rule:
            found[tuple(sorted((f, low, t) for (f, low), t in rule.items()))] = None
        if trees.left[node] < 0:
            return
        f, t = int(trees.feature[node]), float(trees.threshold[node])
        for child, low in ((trees.left[node], True), (trees.right[node], False)):
            key = (f, low)
            tighter = (min if low else max)(t, rule[key]) if key in rule else t
            walk(int(child), rule | {key: tighter})

    for root in trees.roots.tolist():
        walk(root, {})
    return list(found)


def fires(rules: list[tuple[tuple[int, bool, float], ...]], x: np.ndarray) -> np.ndarray:
    """[row, rule] 1.0 where all parts of a rule hold."""
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, low, t in rule:
            out[:, k] *= (x[:, f] <= t) if low else (x[:, f] > t)
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + penalty x sum of |weights|, by accelerated proximal gradient."""
    n, m = x.shape
    rate_of_1 = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate_of_1 / (1 - rate_of_1)))
    w = np.zeros(m)
    if not n or not m or not 0 < y.sum() < n:
        return w, bias
    centre = x.mean(axis=0)
    z = x - centre
    top = np.ones(m)
    for _ in range(30):  # the largest eigenvalue of z'z / n by power iteration
        top = z.T @ (z @ top) / n
        largest = float(np.linalg.norm(top))
        if largest < 1e-12:
            return w, bias
        top /= largest
    step = 4.0 / (1.05 * largest + 1.0)
    v, vb, prev, prevb, t = w.copy(), bias, w.copy(), bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + vb)))
        w = v - step * (z.T @ (p - y) / n)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = vb - step * (p - y).mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w + (t - 1) / t2 * (w - prev), b + (t - 1) / t2 * (b - prevb)
        prev, prevb, t = w, b, t2
    return prev, float(prevb - centre @ prev)
