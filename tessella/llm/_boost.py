"""Small regression trees on binned features, for boosting on the driver over a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """x[feature] <= cut goes left; a leaf has no feature."""

    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Boost:
    """Gradient-boosted trees for log loss. Deterministic: each tree sees a seeded share of the rows."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    least: int = 8
    shrink: float = 1.0
    share: float = 0.7
    bins: int = 48
    seed: int = 1
    start: float = 0.0
    roots: list[Node] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        if not len(x):
            self.start, self.roots = 0.0, []
            return self
        rng = np.random.default_rng(self.seed)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # Rare positive values get cuts of their own: a count that is mostly zero has no other quantile.
        cuts = [np.unique(np.concatenate([k, np.quantile(c[c > c.min()], np.linspace(0, 1, 9)[:-1]), [c.min()]])) if (c > c.min()).any() else k for k, c in zip(cuts, x.T, strict=True)]
        codes = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], 1)
        p = (y.sum() + 1) / (len(y) + 2)
        self.start, self.roots = float(np.log(p / (1 - p))), []
        z = np.full(len(y), self.start)
        for _ in range(self.trees):
            q = sigmoid(z)
            rows = np.flatnonzero(rng.random(len(y)) < self.share)
            root = self._grow(codes, cuts, y - q, np.maximum(q * (1 - q), 1e-6), rows, self.depth)
            self.roots.append(root)
            z = z + apply(root, x)
        return self

    def _grow(self, codes, cuts, g, h, rows, depth) -> Node:
        gs, hs = g[rows].sum(), h[rows].sum()
        node = Node(float(self.rate * gs / (hs + self.shrink)))
        if depth == 0 or len(rows) < 2 * self.least:
            return node
        best, at = 1e-9 + gs * gs / (hs + self.shrink), None
        for f, k in enumerate(cuts):
            if not len(k):
                continue
            c = codes[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(c, weights=w, minlength=len(k) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + self.shrink) + (gs - gl) ** 2 / (hs - hl + self.shrink)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
            i = int(gain.argmax())
            if gain[i] > best + 1e-6:
                best, at = gain[i], (f, i)
        if at is None:
            return node
        f, i = at
        to_left = codes[rows, f] <= i
        node.feature, node.cut = f, float(cuts[f][i])
        node.left = self._grow(codes, cuts, g, h, rows[to_left], depth - 1)
        node.right = self._grow(codes, cuts, g, h, rows[~to_left], depth - 1)
        return node

    def decide(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for root in self.roots:
            z += apply(root, x)
        return z


def apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    out, left = np.empty(len(x)), x[:, node.feature] <= node.cut
    out[left], out[~left] = apply(node.left, x[left]), apply(node.right, x[~left])
    return out


def isotonic(z: np.ndarray, y: np.ndarray, prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and rising probabilities between 0 and 1, to be interpolated."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, weight, low and high end
    for v, t in zip(z[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(v), float(v)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], hi]
    value = [(s + prior * y.mean()) / (w + prior) for s, w, _, _ in blocks]
    value = np.maximum.accumulate(np.repeat(value, 2))
    return np.array([e for b in blocks for e in b[2:]]), value


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs in the right order; ties count half."""
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = y.sum()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(1, pos * (len(y) - pos)))
