"""Gradient-boosted trees: fitted with numpy on a bounded sample, flattened into node arrays, scored without a loop over rows.

Trees are complete binary trees of one depth, so a row's way through all trees is ``depth`` vectorised steps. A feature may be
constrained to raise (+1) or lower (-1) the score: splits that would do otherwise are not taken, and both sides of a taken split
are bounded by its middle value, which keeps the whole tree monotonic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    base: float
    depth: int
    feature: np.ndarray  # (trees, nodes)
    threshold: np.ndarray  # (trees, nodes); a row goes right if its value is larger
    value: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(np.asarray(x, float))
        score = np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.take_along_axis(x, feature[node][:, None], 1)[:, 0] > threshold[node])
            score += value[node - (2**self.depth - 1)]
        return score

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, constraint: list[int], trees: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Logistic loss, second-order splits on quantile bins. Deterministic: no sampling of rows or features."""
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)  # bin b: value <= edges[b]
    nodes, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    margin = np.full(len(x), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        low, high = np.full(nodes + leaves, -np.inf), np.full(nodes + leaves, np.inf)
        node = np.zeros(len(x), np.int64)
        for k in range(nodes):
            own = node == k
            low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = low[k], high[k]
            g, h = gradient[own], weight[own]
            best, total, all_h = 1e-9, g.sum(), h.sum()
            chosen = None
            for f, edge in enumerate(edges):
                if not len(edge) or own.sum() < 2:
                    continue
                left_g = np.cumsum(np.bincount(binned[own, f], g, len(edge) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[own, f], h, len(edge) + 1))[:-1]
                left = np.clip(left_g / (left_h + ridge), low[k], high[k])
                right = np.clip((total - left_g) / (all_h - left_h + ridge), low[k], high[k])
                gain = left_g**2 / (left_h + ridge) + (total - left_g) ** 2 / (all_h - left_h + ridge) - total**2 / (all_h + ridge)
                gain[(left_h < 1e-3) | (all_h - left_h < 1e-3) | (constraint[f] * (right - left) < 0)] = 0
                b = int(np.argmax(gain))
                if gain[b] > best:
                    best, chosen = gain[b], (f, edge[b], (left[b] + right[b]) / 2)
            if chosen:
                feature[k], threshold[k], middle = chosen
                sign = constraint[feature[k]]
                if sign:
                    (high if sign > 0 else low)[2 * k + 1] = middle
                    (low if sign > 0 else high)[2 * k + 2] = middle
            node[own] = 2 * k + 1 + (x[own, feature[k]] > threshold[k])
        leaf = node - nodes
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        value = rate * np.clip(g / (h + ridge), low[nodes:], high[nodes:])
        features.append(feature), thresholds.append(threshold), values.append(value)
        margin += value[leaf]
    return Forest(base, depth, np.stack(features), np.stack(thresholds), np.stack(values))
