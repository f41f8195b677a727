"""Gradient-boosted regression trees with logistic loss, on binned features, in numpy."""

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete trees of one depth: a node's children are 2 i + 1 and 2 i + 2; a row goes right if its value is above the cut."""

    start: float
    feature: np.ndarray  #: (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  #: (trees, leaves)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        out, each = np.full(len(rows), self.start), np.arange(len(rows))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[each, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 1.0, part: float = 1.0, seed: int = 0) -> Trees:
    """Trees that lower the weighted logistic loss by second-order steps; split gains use sums of bins of each feature.

    Each tree chooses its splits by a drawn ``part`` of the rows; all rows give the values of its leaves.
    """
    draw = np.random.default_rng(seed)
    many, features = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = np.clip(np.average(labels, weights=weights), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score, inner = np.full(many, start), (1 << depth) - 1
    out_feature, out_cut, out_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = weights * (p - labels), weights * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(many, np.int64)
        drawn = np.flatnonzero(draw.random(many) < part)
        slope_d, bend_d, binned_d = slope[drawn], bend[drawn], binned[drawn]
        for level in range(depth):
            at_d = (at[drawn] - (1 << level) + 1) * bins
            first, nodes = (1 << level) - 1, 1 << level
            gains = np.full((nodes, features), -np.inf)
            places = np.zeros((nodes, features), np.int64)
            for f in range(features):
                if not len(cuts[f]):
                    continue
                slot = at_d + binned_d[:, f]
                g = np.bincount(slot, slope_d, nodes * bins).reshape(nodes, bins)
                h = np.bincount(slot, bend_d, nodes * bins).reshape(nodes, bins)
                left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                all_g, all_h = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
                gain[(left_h < least) | (all_h - left_h < least)] = -np.inf
                gain[:, len(cuts[f]) :] = -np.inf
                places[:, f] = gain.argmax(1)
                gains[:, f] = gain.max(1)
            chosen = gains.argmax(1)
            for node in np.flatnonzero(gains.max(1) > 1e-6):
                f = chosen[node]
                feature[first + node], cut[first + node] = f, cuts[f][places[node, f]]
            at = 2 * at + 1 + (rows[np.arange(many), feature[at]] > cut[at])
        leaf_of = at - inner
        g, h = np.bincount(leaf_of, slope, inner + 1), np.bincount(leaf_of, bend, inner + 1)
        leaf = -rate * g / (h + penalty)
        score += leaf[leaf_of]
        out_feature.append(feature)
        out_cut.append(cut)
        out_leaf.append(leaf)
    return Trees(start, np.array(out_feature), np.array(out_cut), np.array(out_leaf))
