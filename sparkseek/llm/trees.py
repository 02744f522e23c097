"""Gradient-boosted trees on histograms, for classifiers fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays: feature (-1 a leaf), edge, left child (the right one follows), value."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(x), self.base)
        for feature, edge, left, value in self.trees:
            node = np.zeros(len(x), int)
            while True:
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = left[at] + (x[inner, f[inner]] > edge[at])
            out += value[node]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.3, bins: int = 32, least: int = 5, ridge: float = 1.0) -> Boosted:
    """Logistic loss, Newton leaf values, exact best split over at most `bins` quantile edges a feature. One class or no rows give a constant."""
    n = len(x)
    share = y.mean() if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        return Boosted(8.0 if share == 1.0 else -8.0, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # an edge at the greatest value splits nothing off
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(np.log(share / (1 - share)))
    score, out = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, edge, left, value, members = [-1], [0.0], [0], [0.0], [np.arange(n)]
        todo = [(0, 0)]
        while todo:
            node, level = todo.pop()
            rows = members[node]
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + ridge)
            if level == depth or len(rows) < 2 * least:
                continue
            best = (1e-6, -1, -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1]
                hl = np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1]
                nl = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] < 0:
                continue
            _, j, k = best
            goes_left = binned[rows, j] <= k
            feature[node], edge[node], left[node] = j, float(edges[j][k]), len(feature)
            for part in (rows[goes_left], rows[~goes_left]):
                feature.append(-1), edge.append(0.0), left.append(0), value.append(0.0), members.append(part)
                todo.append((len(feature) - 1, level + 1))
        for node, f in enumerate(feature):
            if f < 0:
                score[members[node]] += value[node]
        out.append((np.array(feature), np.array(edge), np.array(left), np.array(value)))
    return Boosted(base, out)
