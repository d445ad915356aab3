"""Simulated markets: a generator of embeddings fitted by place, structural models with and without an effect of text, and estimators held against them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.operators.audit import ridge
from lotweave.operators.estimate import hash_number
from lotweave.operators.learners import Boosted, Network, cross_fit, effect, folds_of, principal, standardise
from lotweave.operators.ranking import global_rank
from lotweave.session import Scratch

#: Slopes of the outcome on place and on the first confounder, and its noise.
PLACE_SLOPE, CONFOUNDER_SLOPE, NOISE = 0.6, 0.4, 0.3


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same each time and in any engine: those with the smallest hashes of key and seed."""
    return df.orderBy(hash_number(F.col(key), seed), key).limit(n)


def place_scores(df: DataFrame, label: str, out: str = "z") -> DataFrame:
    """df with its label's rank among the sorted labels, spread evenly over [-1, 1]; -1 for a single label. Only the distinct labels are ranked, over ranges."""
    labels = global_rank(df.where(F.col(label).isNotNull()).select(label).distinct(), [F.col(label)], Scratch(df.sparkSession), "_r")
    many = labels.agg(F.count("*").alias("_n"))
    score = F.when(F.col("_n") == 1, -1.0).otherwise(2.0 * F.col("_r") / (F.col("_n") - 1) - 1)
    return df.join(labels.crossJoin(F.broadcast(many)).select(label, score.alias(out)), label, "left")  # one row


def variance_share_slope(df: DataFrame, outcome: Column, projection: Column, share: float) -> DataFrame:
    """One row (var_outcome, var_projection, slope): the slope at which a projection's effect makes up a share of the outcome's variance."""
    s = df.agg(F.var_samp(outcome).alias("var_outcome"), F.var_samp(projection).alias("var_projection"))
    return s.withColumn("slope", F.when(F.col("var_projection") > 1e-12, F.sqrt(share / (1 - share) * F.col("var_outcome") / F.col("var_projection"))).otherwise(0.0))


def bin_summaries(df: DataFrame, label: str, vector: str, rank: int = 10, least: int = 10) -> DataFrame:
    """(label, n, own, mean, loadings, noise): each bin's low-rank normal distribution of vectors; own: it has rows enough, else it takes that of all rows.

    A bin's moments are summed before the shuffle, so its rows are never gathered: d (d + 3) / 2 numbers a bin, whatever its rows.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    d = rows.select(F.size("v").alias("d")).first()
    d = d["d"] if d else 0
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in pairs]).alias("q"))
    whole = sums.agg(F.sum("n").alias("wn"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("ws"), F.array(*[F.sum(F.col("q")[k]) for k in range(len(pairs))]).alias("wq"))
    at_i, at_j = np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int)

    def work(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                own = r.n >= least
                n, s, q = (r.n, r.s, r.q) if own else (r.wn, r.ws, r.wq)
                mean = np.asarray(s) / n
                second = np.zeros((d, d))
                second[at_i, at_j] = second[at_j, at_i] = np.asarray(q)
                cov = (second - n * np.outer(mean, mean)) / max(n - 1, 1)
                if own:
                    values, vectors = np.linalg.eigh(cov)
                    k = max(1, min(rank, int(r.n) - 1, d))
                    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
                    noise = max(float(np.maximum(values[::-1][k:], 0).sum()) / d, 1e-8)
                else:
                    load, noise = np.zeros((d, 0)), float(np.diag(cov).mean()) + 1e-8
                out.append((r.label, r.n, own, mean.tolist(), load.ravel().tolist(), noise))
            yield pd.DataFrame(out, columns=["label", "n", "own", "mean", "loadings", "noise"])

    kind = df.schema[label].dataType.simpleString()
    return sums.crossJoin(F.broadcast(whole)).mapInPandas(work, f"label {kind}, n bigint, own boolean, mean array<double>, loadings array<double>, noise double")  # one row


@dataclass
class Generator:
    """Samples places and embeddings; bins' frequencies, means, loadings and noise, and the direction the effect acts along."""

    share: np.ndarray
    means: np.ndarray
    loadings: list[np.ndarray]
    noise: np.ndarray
    direction: np.ndarray

    def sample(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        at = rng.choice(len(self.share), n, p=self.share)
        e = self.means[at] + rng.normal(size=(n, self.means.shape[1])) * np.sqrt(self.noise[at])[:, None]
        for b in np.unique(at):
            rows = np.flatnonzero(at == b)
            if self.loadings[b].shape[1]:
                e[rows] += rng.normal(size=(len(rows), self.loadings[b].shape[1])) @ self.loadings[b].T
        return at / max(len(self.share) - 1, 1) * 2 - 1, e


def generator_of(summaries: DataFrame, most_bins: int = 10_000) -> Generator:
    """A generator from a row a bin; more than most_bins are refused."""
    rows = summaries.orderBy("label").limit(most_bins + 1).collect()
    if len(rows) > most_bins:
        raise ValueError(f"more than {most_bins} bins")
    n, means = np.array([r["n"] for r in rows], float), np.array([r["mean"] for r in rows])
    middle = np.average(means, axis=0, weights=n)
    d = means.shape[1]
    loadings = [np.array(r["loadings"]).reshape(d, -1) for r in rows]
    cov = sum(w * (np.outer(m - middle, m - middle) + u @ u.T) for w, m, u in zip(n / n.sum(), means, loadings)) + np.eye(d) * np.average([r["noise"] for r in rows], weights=n)
    return Generator(n / n.sum(), means, loadings, np.array([r["noise"] for r in rows]), np.linalg.eigh(cov)[1][:, -1])


def market(gen: Generator, n: int, slope: float, rng: np.random.Generator, confounders: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, places, confounders, outcome) of a structural model; slope 0: text does nothing."""
    z, e = gen.sample(n, rng)
    w = [z + 0.5 * rng.normal(size=n), np.sin(np.pi * z) + 0.4 * rng.normal(size=n), np.cos(2 * z) + 0.4 * rng.normal(size=n), z**2 - 0.5 + 0.5 * rng.normal(size=n), np.tanh(2 * z) + 0.3 * rng.normal(size=n)]
    w = np.column_stack([*w, *[rng.normal(size=n) for _ in range(confounders - 5)]])[:, :confounders]
    return e, z, w, PLACE_SLOPE * z + CONFOUNDER_SLOPE * w[:, 0] + slope * (e @ gen.direction) + NOISE * rng.normal(size=n)


def calibrated_slope(gen: Generator, share: float, n: int = 20_000, seed: int = 20) -> float:
    """The slope at which the effect makes up a share of the outcome's variance, by a large sample."""
    if share <= 0:
        return 0.0
    e, _, _, y = market(gen, n, 0.0, np.random.default_rng(seed))
    return float(np.sqrt(share / (1 - share) * y.var(ddof=1) / (e @ gen.direction).var(ddof=1)))


def _residual_effect(e: np.ndarray, w: np.ndarray, y: np.ndarray, predict: Callable) -> tuple[float, float]:
    t = standardise(principal(e, 1))[:, 0]
    theta, se, _ = effect(y - predict(w, y), t - predict(w, t))
    return theta, se


def naive(e, z, w, y, seed):
    """The first component alone, nothing adjusted."""
    t = standardise(principal(e, 1))[:, 0]
    return effect(y - y.mean(), t)[:2]


def linear(e, z, w, y, seed):
    """Ridge regressions on the confounders, cross-fitted."""

    def predict(x, v):
        at, out = folds_of(len(v), 5, seed), np.zeros(len(v))
        for f in range(5):
            b, a = ridge(x[at != f], v[at != f], 1e-6)
            out[at == f] = x[at == f] @ b + a
        return out

    return _residual_effect(e, w, y, predict)


def boosted(e, z, w, y, seed, trees: int = 60, depth: int = 3):
    """Boosted trees on confounders, cross-fitted."""
    return _residual_effect(e, w, y, lambda x, v: cross_fit(x, v, seed=seed, make=lambda: Boosted(trees, depth, seed=seed)))


def adversarial(e, z, w, y, seed, epochs: int = 120):
    """The same on a code of the embedding from which an adversary can't tell the place."""
    x, place = standardise(e), z[:, None]
    enc, head, disc = Network([x.shape[1], 16, 4], seed), Network([4, 1], seed + 1), Network([4, 8, 1], seed + 2)
    v = (y - y.mean()) / (y.std() or 1)
    for k in range(epochs):
        code = enc.forward(x)
        g = head.backward(2 * (head.forward(code) - v[:, None]) / len(v), 5e-3, 1e-4)
        g = g - min(1.0, k / (epochs / 2)) * disc.backward(2 * (disc.forward(code) - place) / len(v), 5e-3, 1e-4)
        enc.backward(g, 5e-3, 1e-4)
    return boosted(enc.forward(x), z, w, y, seed)


#: Estimators by name; each takes (embeddings, places, confounders, outcome, seed) and gives (effect, error).
ESTIMATORS: dict[str, Callable] = {"naive": naive, "linear": linear, "boosted": boosted, "adversarial": adversarial}


def replicates(spark: SparkSession, gen: Generator, sizes: tuple[int, ...] = (500, 1000), shares: tuple[float, ...] = (0.0, 0.01, 0.05, 0.1), reps: int = 20, names: tuple[str, ...] = tuple(ESTIMATORS), seed: int = 1) -> DataFrame:
    """(estimator, n, share, rep, truth, theta, se, ci_low, ci_high, error), a replicate and estimator to a task; one that fails has nulls and keeps its cell.

    The truth is the linear projection of the outcome's text part on the first component, from a large sample of each share; a component has no
    sign of its own, so effects are given for the one that points along the generator's direction.
    """
    slopes, truths = {}, {}
    for s in shares:
        slopes[s] = calibrated_slope(gen, s)
        e = market(gen, 20_000, slopes[s], np.random.default_rng(99))[0]
        t = standardise(principal(e, 1))[:, 0]
        truths[s] = float(abs((t * (e @ gen.direction)).mean()) * slopes[s])
    cells = [(e, n, float(s), r) for e in names for n in sizes for s in shares for r in range(reps)]
    grid = spark.createDataFrame(cells, "estimator string, n int, share double, rep int").repartition(min(len(cells), 256))
    shared = spark.sparkContext.broadcast(gen)  # a row a bin

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, r.n, int(r.share * 1e4), r.rep])
                try:
                    e, *rest = market(shared.value, r.n, slopes[r.share], rng)
                    theta, se = ESTIMATORS[r.estimator](e, *rest, r.rep)
                    theta *= np.sign((standardise(principal(e, 1))[:, 0] * (e @ gen.direction)).mean()) if r.estimator != "adversarial" else 1.0
                    rows.append((*r, truths[r.share], theta, se, theta - 1.96 * se, theta + 1.96 * se, None))
                except (np.linalg.LinAlgError, ValueError) as x:
                    rows.append((*r, truths[r.share], None, None, None, None, str(x)))
            yield pd.DataFrame(rows, columns=["estimator", "n", "share", "rep", "truth", "theta", "se", "ci_low", "ci_high", "error"])

    return grid.mapInPandas(run, "estimator string, n int, share double, rep int, truth double, theta double, se double, ci_low double, ci_high double, error string")
