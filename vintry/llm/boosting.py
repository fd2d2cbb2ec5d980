"""Gradient-boosted trees on dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES = 80
DEPTH = 3
RATE = 0.15
BINS = 32
LEAST_WEIGHT = 5.0
RIDGE = 1.0


@dataclass
class Tree:
    """A complete binary tree: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def leaf_values(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            right = x[rows, self.feature[node]] > self.limit[node]
            node = 2 * node + 1 + right
        return self.value[node]


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
    nodes = 2 ** (DEPTH + 1) - 1
    tree = Tree(np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes))
    at = np.zeros(len(g), np.int64)
    for node in range(nodes):
        mine = at == node
        sum_g, sum_h = g[mine].sum(), h[mine].sum()
        tree.value[node] = -sum_g / (sum_h + RIDGE)
        if node >= 2**DEPTH - 1 or not mine.any():
            if 2 * node + 1 < nodes:
                tree.value[2 * node + 1] = tree.value[2 * node + 2] = tree.value[node]
            continue
        best = (1e-9, 0, np.inf, 0)
        for f, limits in enumerate(edges):
            if not len(limits):
                continue
            left_g = np.cumsum(np.bincount(binned[mine, f], g[mine], len(limits) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[mine, f], h[mine], len(limits) + 1))[:-1]
            gain = (
                left_g**2 / (left_h + RIDGE)
                + (sum_g - left_g) ** 2 / (sum_h - left_h + RIDGE)
                - sum_g**2 / (sum_h + RIDGE)
            )
            gain[(left_h < LEAST_WEIGHT / 4) | (sum_h - left_h < LEAST_WEIGHT / 4)] = 0
            b = int(gain.argmax())
            if gain[b] > best[0]:
                best = (gain[b], f, limits[b], b)
        # Without a useful split all rows go left, to a node that gives the same value.
        _, f, limit, b = best
        tree.feature[node], tree.limit[node] = f, limit
        right = binned[:, f] > b if np.isfinite(limit) else np.zeros(len(g), bool)
        at[mine] = 2 * node + 1 + right[mine]
    return tree


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += RATE * tree.leaf_values(x)
        return total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Boosted:
    """Logistic boosting with second-order leaf values and quantile bins."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    # The rarest values matter most where nearly all are equal.
    edges = [
        np.unique(np.concatenate([e, np.quantile(c[c > c.min()], np.linspace(0, 0.9, 10)) - 1e-12]))
        if (c > c.min()).any() else e
        for e, c in zip(edges, x.T)
    ]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)
    mean = np.clip((weights * y).sum() / weights.sum(), 1e-6, 1 - 1e-6)
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    z = np.full(len(y), model.start)
    for _ in range(TREES):
        p = _sigmoid(z)
        tree = _grow(binned, edges, weights * (p - y), weights * p * (1 - p))
        model.trees.append(tree)
        z += RATE * tree.leaf_values(x)
    return model


@dataclass
class Isotonic:
    """A rising step-free curve through the pooled means."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.at, self.value)


def isotonic(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Isotonic:
    """Pool adjacent violators over the margins, equal margins first."""
    at, places = np.unique(z, return_inverse=True)
    w = np.bincount(places, weights)
    mean = np.bincount(places, weights * y) / w
    blocks: list[list[float]] = []  # mean, weight, first and last margin
    for m, v, a in zip(mean, w, at):
        blocks.append([m, v, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, v2, _, b = blocks.pop()
            blocks[-1][0] = (blocks[-1][0] * blocks[-1][1] + m2 * v2) / (blocks[-1][1] + v2)
            blocks[-1][1] += v2
            blocks[-1][3] = b
    return Isotonic(
        np.array([p for b in blocks for p in (b[2], b[3])]),
        np.array([b[0] for b in blocks for _ in (0, 1)]),
    )
