"""Gradient-boosted trees on small integer features, for binary labels; fitted on the driver, used anywhere."""

from __future__ import annotations

import numpy as np

BINS = 16


class Boosted:
    """Logistic boosting with trees of fixed depth over features clipped to ``0 .. BINS - 1``."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, least: int = 6):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.clip(x, 0, BINS - 1).astype(np.int64)
        n, width = x.shape
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        code = x + np.arange(width) * BINS
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            size = 2**self.depth
            feature, bound = np.zeros(size, np.int64), np.full(size, BINS, np.int64)  # BINS: all go left
            node = np.ones(n, np.int64)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    at = np.flatnonzero(node == k)
                    if len(at) < 2 * self.least:
                        continue
                    flat = code[at].ravel()
                    sums = [np.bincount(flat, np.repeat(w[at], width), minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, hess)]
                    count = np.bincount(flat, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                    g, h = sums[0][0, -1], sums[1][0, -1]
                    gain = sums[0] ** 2 / (sums[1] + self.ridge) + (g - sums[0]) ** 2 / (h - sums[1] + self.ridge)
                    gain[(count < self.least) | (len(at) - count < self.least)] = -1
                    best = int(gain.argmax())
                    if gain.flat[best] > g * g / (h + self.ridge) + 1e-6:
                        feature[k], bound[k] = divmod(best, BINS)
                node = 2 * node + (x[np.arange(n), feature[node]] > bound[node])
            leaf = node - size
            value = self.rate * np.bincount(leaf, grad, minlength=size) / (np.bincount(leaf, hess, minlength=size) + self.ridge)
            self.trees.append((feature, bound, value))
            score += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, BINS - 1).astype(np.int64)
        row = np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, bound, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[row, feature[node]] > bound[node])
            score += value[node - 2**self.depth]
        return score


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset by which a logistic curve turns margins into probabilities."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * margin).sum() - 1e-3 * (a - 1), (y - p).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return float(a), float(b)


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
    """The probability from which on F-beta is highest; the middle of the gap to the next lower one."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = y[order].cumsum()
    f = (1 + beta**2) * hits / (np.arange(1, len(p) + 1) + beta**2 * y.sum())
    k = int(f.argmax())
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)
