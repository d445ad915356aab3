"""Studies of what probes of a code can find: simulated data, a replicate (probe, trial, weight) to a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.operators.audit import capacity_ladder
from lotweave.operators.identification import GRAPH, directed_paths, minimal_sets
from lotweave.operators.learners import Network, cross_entropy, logistic, per_group, probability, softmax

LN2 = float(np.log(2.0))
#: Hidden layers of the probes, from none that sees its input at all to the widest; None is a constant.
PROBES: dict[str, list[int] | None] = {"constant": None, "linear": [], "hidden_2": [2], "hidden_8": [8], "hidden_32_32": [32, 32]}


def cells(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One row for each replicate, each in a task of its own."""
    return spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))


def exclusive_or(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fair bits of each row, and their exclusive or."""
    x = np.random.default_rng(seed).integers(0, 2, (n, 2))
    return x.astype(float), x[:, 0] ^ x[:, 1]


def fitted(layers: list[int] | None, x: np.ndarray, c: np.ndarray, seed: int, steps: int = 600, rate: float = 0.03) -> np.ndarray:
    """Log-odds rows (n, 2) of a probe with such layers trained on x to tell c; of the best of three starts, since small nets get stuck."""
    if layers is None:
        p = np.bincount(c, minlength=2) / len(c)
        return np.log(np.clip(np.tile(p, (len(c), 1)), 1e-9, 1))
    one_hot, best = np.eye(2)[c], None
    for start in range(3 if layers else 1):
        net = Network([x.shape[1], *layers, 2], 1000 * seed + start)
        for _ in range(steps):
            net.backward((softmax(net.forward(x)) - one_hot) / len(c), rate)
        z = net.forward(x)
        if best is None or cross_entropy(z, c) < cross_entropy(best, c):
            best = z
    return best


def entropy(c: np.ndarray) -> float:
    p = np.bincount(c, minlength=2) / len(c)
    return float(-(p[p > 0] * np.log(p[p > 0])).sum())


def bound(z: np.ndarray, c: np.ndarray) -> float:
    """The information a probe proves: the label's entropy less the probe's cross-entropy, at least 0."""
    return max(0.0, entropy(c) - cross_entropy(z, c))


def probe_bounds(spark: SparkSession, n: int = 4000, trials: int = 3) -> DataFrame:
    """(probe, hidden, trial, nats): what each probe proves of an exclusive or; all but the linear ones reach ln 2."""
    grid = cells(spark, [(p, i, t) for i, p in enumerate(PROBES) for t in range(trials)], "probe string, hidden int, trial int")

    def work(pdf: pd.DataFrame) -> dict:
        x, c = exclusive_or(n, int(pdf["trial"].iloc[0]))
        return {"nats": bound(fitted(PROBES[pdf["probe"].iloc[0]], x, c, int(pdf["trial"].iloc[0])), c)}

    return per_group(grid, ["probe", "hidden", "trial"], work, "probe string, hidden int, trial int, nats double")


def bound_chain(bounds: DataFrame, slack: float = 0.01) -> DataFrame:
    """(probe, hidden, nats, not_below_last, within) of probes by capacity: the best trial of each, whether it proves no less than the one before, and no more than ln 2."""
    best = bounds.groupBy("probe", "hidden").agg(F.max("nats").alias("nats"))
    last = best.select((F.col("hidden") + 1).alias("hidden"), F.col("nats").alias("_last"))
    return best.join(last, "hidden", "left").select("probe", "hidden", "nats", (F.coalesce("_last", F.lit(0.0)) <= F.col("nats") + slack).alias("not_below_last"), F.col("nats").between(0, LN2 + slack).alias("within"))


def reversed_game(spark: SparkSession, trials: int = 3, n: int = 1500, epochs: int = 150) -> DataFrame:
    """(trial, live, frozen_linear, frozen_hidden): accuracy on held-out rows of a linear discriminator that an encoder was trained to fool, and of probes
    of the frozen code. The label is the sign of a product of two inputs, the outcome half the third input."""
    grid = cells(spark, [(t,) for t in range(trials)], "trial int")

    def work(pdf: pd.DataFrame) -> dict:
        t = int(pdf["trial"].iloc[0])
        rng = np.random.default_rng(500 + t)
        x = rng.normal(size=(n, 10))
        c, y = (x[:, 0] * x[:, 1] > 0).astype(int), 0.5 * x[:, 2] + 0.1 * rng.normal(size=n)
        train, one_hot = np.arange(n) < n * 7 // 10, np.eye(2)[c]
        enc, head, disc = Network([10, 32, 16], t), Network([16, 1], t + 1), Network([16, 2], t + 2)
        for _ in range(epochs):
            code = enc.forward(x[train], last_linear=False)
            g = head.backward(2 * (head.forward(code)[:, 0] - y[train])[:, None] / train.sum(), 5e-3)
            g = g - disc.backward((softmax(disc.forward(code)) - one_hot[train]) / train.sum(), 5e-3)
            enc.backward(g, 5e-3, last_linear=False)
        code = enc.forward(x, last_linear=False)
        live = disc.forward(code[~train]).argmax(axis=1)
        out = {"live": float((live == c[~train]).mean())}
        scaled = (code - code.mean(axis=0)) / (code.std(axis=0) + 1e-9)
        for name, layers in (("frozen_linear", []), ("frozen_hidden", [64])):
            net = Network([16, *layers, 2], t)
            for _ in range(400):
                net.backward((softmax(net.forward(scaled[train])) - one_hot[train]) / train.sum(), 0.01, 1e-3)
            out[name] = float((net.forward(scaled[~train]).argmax(axis=1) == c[~train]).mean())
        return out

    return per_group(grid, ["trial"], work, "trial int, live double, frozen_linear double, frozen_hidden double")


def ladder_gate(spark: SparkSession, n: int = 2000, trials: int = 3) -> DataFrame:
    """(check, value, limit, passed): whether the experiments came out as claimed: a linear probe proves nothing, a hidden layer nearly all; bounds rise with capacity.

    The rows of the experiments are aggregated, and the limits are part of the claim.
    """
    best = probe_bounds(spark, n, trials).groupBy("probe").agg(F.avg("nats").alias("nats"))
    found = {r["probe"]: r["nats"] for r in best.collect()}  # a row a probe
    rungs = [r["nats"] for r in capacity_ladder(spark, n, trials).groupBy("rung").agg(F.avg("nats").alias("nats")).orderBy("rung").collect()]  # a row a rung
    drop = max(a - b for a, b in zip(rungs, rungs[1:]))
    top = found["hidden_32_32"]
    rows = [
        ("linear_near_zero", found["linear"], 0.05, found["linear"] < 0.05),
        ("hidden_near_all", top, LN2 - 0.05, top >= LN2 - 0.05),
        ("gap", top - found["linear"], 0.6, top - found["linear"] >= 0.6),
        ("ladder_falls_at_most", drop, 0.05, drop <= 0.05),
        ("ladder_top", rungs[-1], 0.95 * LN2, rungs[-1] > 0.95 * LN2),
    ]
    return spark.createDataFrame([(a, float(b), float(c), bool(d)) for a, b, c, d in rows], "check string, value double, limit double, passed boolean")


def identity_gap(spark: SparkSession, n: int = 3000, trials: int = 3) -> DataFrame:
    """(trial, by_loss, by_likelihood, gap): a probe's bound as entropy less loss, and as entropy plus the mean log-likelihood of each row's own label."""
    grid = cells(spark, [(t,) for t in range(trials)], "trial int")

    def work(pdf: pd.DataFrame) -> dict:
        t = int(pdf["trial"].iloc[0])
        rng = np.random.default_rng(42 + t)
        c = rng.integers(0, 2, n)
        z = fitted([16], c[:, None] + 0.5 * rng.normal(size=(n, 4)), c, t, 200)
        odds = z[:, 1] - z[:, 0]
        own = np.where(c == 1, -np.logaddexp(0, -odds), -np.logaddexp(0, odds))
        a, b = entropy(c) - cross_entropy(z, c), entropy(c) + float(own.mean())
        return {"by_loss": a, "by_likelihood": b, "gap": abs(a - b)}

    return per_group(grid, ["trial"], work, "trial int, by_loss double, by_likelihood double, gap double")


def information_of_shift(shift: float = 1.0, width: float = 12.0, steps: int = 200_001) -> float:
    """Information between a fair bit and a normal shifted by it, by numeric integration."""
    z = np.linspace(-width, width + shift, steps)
    p0, p1 = np.exp(-(z**2) / 2) / np.sqrt(2 * np.pi), np.exp(-((z - shift) ** 2) / 2) / np.sqrt(2 * np.pi)
    p = (p0 + p1) / 2
    part = sum(0.5 * q * np.log(np.maximum(q, 1e-300) / np.maximum(p, 1e-300)) for q in (p0, p1))
    return float(((part[1:] + part[:-1]) / 2 * np.diff(z)).sum())


def consistency(spark: SparkSession, sizes: tuple[int, ...] = (100, 300, 1000, 3000, 10_000), repeats: int = 20) -> DataFrame:
    """(m, repeat, error): how far a logistic probe's bound, fitted on m rows and measured on m fresh ones, is from the truth."""
    truth = information_of_shift()
    grid = cells(spark, [(m, r) for m in sizes for r in range(repeats)], "m int, repeat int")

    def work(pdf: pd.DataFrame) -> dict:
        m, r = int(pdf["m"].iloc[0]), int(pdf["repeat"].iloc[0])
        rng = np.random.default_rng([m, r])
        c = rng.integers(0, 2, (2, m))
        z = c + rng.normal(size=(2, m))
        if len(set(c[0])) < 2 or len(set(c[1])) < 2:
            return {"error": None}
        p = probability(logistic(z[0][:, None], c[0], 1e6), z[1][:, None])
        loss = -np.log(np.clip(np.where(c[1] == 1, p, 1 - p), 1e-12, 1)).mean()
        return {"error": float(abs(entropy(c[1]) - loss - truth))}

    return per_group(grid, ["m", "repeat"], work, "m int, repeat int, error double")


def rate_of(errors: DataFrame) -> DataFrame:
    """One row (sizes, slope, in_band): slope of the log of the mean error over the log of m; -1/2 for a root-m estimator, the band is -0.7 to -0.3."""
    means = errors.where("error is not null").groupBy("m").agg(F.avg("error").alias("e"))
    s = means.agg(F.count("*").alias("sizes"), F.regr_slope(F.ln("e"), F.ln("m")).alias("slope"))
    return s.select("sizes", "slope", F.col("slope").between(-0.7, -0.3).alias("in_band"))


def saddle_sweep(spark: SparkSession, alphas: tuple[float, ...] = (0.0, 0.5, 2.0, 8.0), seeds: int = 4, n: int = 800, epochs: int = 400) -> DataFrame:
    """(encoder, alpha, seed, linear_nats, hidden_nats, task_loss): what a linear and a hidden probe prove of an exclusive or from a code; for a trained one the linear probe is the discriminator itself as training left it.

    Encoders are fixed (``collapsed`` sends all to one point, ``identity`` keeps the input) or ``trained`` to serve a task, the first bit, weighing alpha,
    while fooling a linear discriminator.
    """
    rows = [("collapsed", 0.0, 0), ("identity", 0.0, 0), *[("trained", a, s) for a in alphas for s in range(seeds)]]
    grid = cells(spark, rows, "encoder string, alpha double, seed int")

    def work(pdf: pd.DataFrame) -> dict:
        kind, alpha, seed = pdf["encoder"].iloc[0], float(pdf["alpha"].iloc[0]), int(pdf["seed"].iloc[0])
        x, c = exclusive_or(n, seed)
        y = x[:, 0].astype(int)
        code, live = np.zeros_like(x) if kind == "collapsed" else x, None
        if kind == "trained":
            enc, task, disc = Network([2, 16, 4], seed), Network([4, 2], seed + 1), Network([4, 2], seed + 2)
            for _ in range(epochs):
                z = enc.forward(x)
                g = alpha * task.backward((softmax(task.forward(z)) - np.eye(2)[y]) / n, 0.02)
                g = g - disc.backward((softmax(disc.forward(z)) - np.eye(2)[c]) / n, 0.02)
                enc.backward(g, 0.02)
            code = enc.forward(x)
            live = bound(disc.forward(code), c)
        s = code.std(axis=0)
        code = (code - code.mean(axis=0)) / np.where(s > 1e-9, s, 1.0)
        return {"linear_nats": bound(fitted([], code, c, seed, 300), c) if live is None else live, "hidden_nats": bound(fitted([16], code, c, seed, 300), c), "task_loss": cross_entropy(fitted([], code, y, seed, 300), y)}

    return per_group(grid, ["encoder", "alpha", "seed"], work, "encoder string, alpha double, seed int, linear_nats double, hidden_nats double, task_loss double")


def saddle_summary(sweep: DataFrame) -> DataFrame:
    """(encoder, alpha, n, linear_nats, hidden_nats, task_loss, wide_gap): means, and the share with a gap of more than half of ln 2."""
    gap = F.col("hidden_nats") - F.col("linear_nats") > LN2 / 2
    return sweep.groupBy("encoder", "alpha").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("linear_nats", "hidden_nats", "task_loss")], F.avg(gap.cast("double")).alias("wide_gap"))


def adjusted_effect(spark: SparkSession, n: int = 1000, seed: int = 0, edges: list[tuple[str, str]] = GRAPH) -> DataFrame:
    """One row (directed, adjustment, estimate, near_zero): whether the graph has a directed path from T to Y, the smallest set that blocks all others, and the
    linear effect of T given it in data the graph made, in which T does nothing."""
    rng = np.random.default_rng(seed)
    v = {"L": rng.normal(size=n)}
    v["X"] = 0.7 * v["L"] + 0.5 * rng.normal(size=n)
    v["C"] = 0.5 * v["L"] + 0.5 * rng.normal(size=n)
    v["T"] = 0.4 * v["L"] + 0.3 * v["X"] + 0.2 * v["C"] + 0.5 * rng.normal(size=n)
    v["Y"] = v["L"] + 0.6 * v["X"] + 0.4 * v["C"] + 0.5 * rng.normal(size=n)
    given = sorted(min(minimal_sets(edges, "T", "Y"), key=len))
    a = np.column_stack([np.ones(n), v["T"], *[v[g] for g in given]])
    estimate = float(np.linalg.lstsq(a, v["Y"], rcond=None)[0][1])
    return spark.createDataFrame([(len(directed_paths(edges, "T", "Y")) > 0, ",".join(given), estimate, abs(estimate) < 0.1)], "directed boolean, adjustment string, estimate double, near_zero boolean")
