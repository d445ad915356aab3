"""Learners in numpy for one group's rows, run side by side, a group (replicate, fold, draw) to a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A group is one replicate of an analysis table, so its rows are bounded by design; larger tables take the linear learners.
MOST_ROWS = 200_000


class Boosted:
    """Gradient-boosted regression trees on histograms; starts from the mean, each tree shrunk."""

    def __init__(self, trees: int = 200, depth: int = 4, rate: float = 0.05, sample: float = 1.0, bins: int = 64, least: int = 1, seed: int = 42):
        self.trees, self.depth, self.rate, self.sample, self.bins, self.least, self.seed = trees, depth, rate, sample, bins, least, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng, (n, p) = np.random.default_rng(self.seed), x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(p)]
        codes = self._codes(x)
        self.start, self.model = float(y.mean()), []
        fit = np.full(n, self.start)
        for _ in range(self.trees):
            rows = np.flatnonzero(rng.random(n) < self.sample) if self.sample < 1 else np.arange(n)
            tree = self._tree(codes, y - fit, rows if len(rows) else np.arange(n))
            self.model.append(tree)
            fit += self.rate * self._apply(tree, codes)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.start + self.rate * sum(self._apply(t, codes) for t in self.model)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _tree(self, codes: np.ndarray, r: np.ndarray, rows: np.ndarray) -> tuple:
        """Level by level: (feature, bin, ...) of all nodes of a full binary tree; a node that isn't split sends all left."""
        p, b, size = codes.shape[1], self.bins, 2**self.depth
        feature, cut = np.zeros(size, dtype=int), np.full(size, b)
        node, c, t = np.ones(len(rows), dtype=int), codes[rows], r[rows]
        flat = c + np.arange(p) * b
        for level in range(self.depth):
            first, k = 2**level, 2**level
            at = ((node - first)[:, None] * (p * b) + flat).ravel()
            s = np.bincount(at, np.repeat(t, p), k * p * b).reshape(k, p, b).cumsum(axis=2)
            m = np.bincount(at, minlength=k * p * b).reshape(k, p, b).cumsum(axis=2)
            all_s, all_m = s[:, :1, -1:], m[:, :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((m >= self.least) & (all_m - m >= self.least) & (m > 0) & (all_m > m), s**2 / m + (all_s - s) ** 2 / (all_m - m) - all_s**2 / np.maximum(all_m, 1), -np.inf)
            gain = gain.reshape(k, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(k), best] > 1e-12
            feature[first : first + k] = np.where(good, best // b, 0)
            cut[first : first + k] = np.where(good, best % b, b)
            node = 2 * node + (c[np.arange(len(rows)), feature[node]] > cut[node])
        sums, counts = np.bincount(node - size, t, size), np.bincount(node - size, minlength=size)
        return feature, cut, np.where(counts > 0, sums / np.maximum(counts, 1), 0.0)

    def _apply(self, tree: tuple, codes: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node, rows = np.ones(len(codes), dtype=int), np.arange(len(codes))
        for _ in range(self.depth):
            node = 2 * node + (codes[rows, feature[node]] > cut[node])
        return leaf[node - 2**self.depth]


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept first, of a logistic regression with an L2 penalty (not on the intercept), by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    penalty, w = np.full(a.shape[1], 1 / strength), np.zeros(a.shape[1])
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


class Network:
    """A small perceptron with rectified hidden layers, trained by Adam; outputs are linear."""

    def __init__(self, sizes: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        self.t = 0

    def forward(self, x: np.ndarray, last_linear: bool = True) -> np.ndarray:
        self.h = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            z = self.h[-1] @ w + b
            self.h.append(z if last_linear and i == len(self.w) - 1 else np.maximum(z, 0))
        return self.h[-1]

    def backward(self, g: np.ndarray, rate: float = 1e-2, decay: float = 0.0, last_linear: bool = True) -> np.ndarray:
        """One step against the gradient of the outputs; the gradient of the inputs."""
        gw, gb = [None] * len(self.w), [None] * len(self.w)
        for i in range(len(self.w) - 1, -1, -1):
            if not (last_linear and i == len(self.w) - 1):
                g = g * (self.h[i + 1] > 0)
            gw[i], gb[i] = self.h[i].T @ g, g.sum(axis=0)
            g = g @ self.w[i].T
        self.step(gw, gb, rate, decay)
        return g

    def step(self, gw: list[np.ndarray], gb: list[np.ndarray], rate: float = 1e-2, decay: float = 0.0) -> None:
        """One step of Adam against the gradients of weights and biases."""
        self.t += 1
        for p, d, s in zip((*self.w, *self.b), (*gw, *gb), self.state):
            d = d + decay * p
            s[0] = 0.9 * s[0] + 0.1 * d
            s[1] = 0.999 * s[1] + 0.001 * d * d
            p -= rate * (s[0] / (1 - 0.9**self.t)) / (np.sqrt(s[1] / (1 - 0.999**self.t)) + 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cross_entropy(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.clip(softmax(z)[np.arange(len(y)), y], 1e-9, 1)).mean())


def folds_of(n: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(np.arange(n) % k)


def cross_fit(w: np.ndarray, target: np.ndarray, k: int = 5, seed: int = 42, make: Callable[[], Boosted] = Boosted) -> np.ndarray:
    """Out-of-fold predictions."""
    at, out = folds_of(len(w), k, seed), np.zeros(len(w))
    for f in range(k):
        test = at == f
        if test.any() and (~test).any():
            out[test] = make().fit(w[~test], target[~test]).predict(w[test])
    return out


def effect(y_res: np.ndarray, t_res: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(theta, se, scores) of the partially linear model; NaN where nothing of the treatment is left."""
    d = float((t_res**2).mean())
    if d < 1e-12:
        return float("nan"), float("nan"), np.zeros_like(y_res)
    theta = float((t_res * y_res).mean()) / d
    psi = (y_res - theta * t_res) * t_res / d
    return theta, float(np.sqrt(psi.var(ddof=1) / len(psi))), psi


def principal(t: np.ndarray, k: int) -> np.ndarray:
    """Scores on the first components of centred rows; the largest loading of each is positive."""
    c = t - t.mean(axis=0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v = v[:k] * np.sign(v[np.arange(min(k, len(v))), np.abs(v[:k]).argmax(axis=1)])[:, None]
    return c @ v.T


def standardise(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s == 0, 1, s)


def per_group(df: DataFrame, group: list[str], work: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row for each group: work's results. A group with more than MOST_ROWS rows is refused, not cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_ROWS:
            raise ValueError(f"a group has {len(pdf)} rows; use the linear learners for more than {MOST_ROWS}")
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in group}, **work(pdf)}])

    return df.groupBy(*group).applyInPandas(run, schema)
