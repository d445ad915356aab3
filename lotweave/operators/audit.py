"""Audits of embeddings: how much of their signal is location, and what effect is left once location is adjusted for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.functions.numeric import calibrate, chi2_sf, portability, regression_robustness, stability, verdict
from lotweave.operators.estimate import fold, mutual_information
from lotweave.operators.learners import MOST_ROWS, Boosted, Network, cross_entropy, cross_fit, effect, folds_of, logistic, per_group, principal, probability, softmax, standardise
from lotweave.session import Scratch

#: Rows of an analysis table: id, city, emb (array<double>), y, w (array<double>: confounders), label, lat, lon.
QUICK = {"trees": 40, "depth": 3}


def feature_rows(emb: DataFrame, parcels: DataFrame, attributes: list[str], zip5) -> DataFrame:
    """The analysis table: listings with an embedding, a positive price and a location, joined with their parcel's attributes by id (missing ones 0)."""
    one = parcels.where(F.trim("parcel_id") != "").groupBy(F.trim("parcel_id").alias("_pid")).agg(*[F.avg(F.when(~F.isnan(F.col(a).cast("double")), F.col(a).cast("double"))).alias(a) for a in attributes])
    rows = emb.where("price > 0 and latitude is not null and longitude is not null and emb is not null").join(one, F.trim("parcel_id") == F.col("_pid"), "left")
    w = F.array(F.col("latitude"), F.col("longitude"), *[F.coalesce(F.col(a), F.lit(0.0)) for a in attributes])
    return rows.select(F.col("emb_id").alias("id"), "city", F.transform("emb", lambda x: x.cast("double")).alias("emb"), F.ln("price").alias("y"), w.alias("w"), zip5(F.col("zip")).alias("label"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def components(df: DataFrame, k: int, column: str = "emb", out: str = "pcs") -> DataFrame:
    """df with the scores on the first k principal components of centred vectors; each component's largest loading is positive."""
    vec = df.withColumn("_v", array_to_vector(F.col(column)))
    mean = vec.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    shift = mean @ load
    scores = F.transform(vector_to_array(F.col("_p")), lambda x, i: (x - F.element_at(F.array(*[F.lit(float(s)) for s in shift]), i + 1)) * F.element_at(F.array(*[F.lit(float(s)) for s in sign]), i + 1))
    return model.transform(vec).withColumn(out, scores).drop("_v", "_p")


def first_component(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, loadings) of the first principal component of vectors; the largest loading is positive."""
    vec = df.select(array_to_vector(F.col(column)).alias("_v"))
    mean = vec.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    load = PCA(k=1, inputCol="_v", outputCol="_p").fit(vec).pc.toArray()[:, 0]
    return mean, load * np.sign(load[np.abs(load).argmax()])


def cluster_label_nmi(df: DataFrame, k: int = 50, seeds: int = 3) -> DataFrame:
    """One row (mi, h_a, h_b, nmi): clusters of the embeddings against the labels; the best of some seeds' clusterings counts."""
    vec = df.where("label is not null").withColumn("features", array_to_vector(F.col("emb"))).select("label", "features")
    models = [KMeans(k=k, seed=s, maxIter=20).fit(vec) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return mutual_information(best.transform(vec).select("label", F.col("prediction").alias("cluster")), "cluster", "label")


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("id")
    return np.vstack(pdf["emb"]), np.vstack(pdf["w"]), pdf["y"].to_numpy(float)


def partial_linear_by_city(df: DataFrame, trees: int = 60, depth: int = 4, seed: int = 42) -> DataFrame:
    """(city, n, theta, se, ci_low, ci_high): effect of the first component, in deviations, with boosted trees cross-fitted in five folds."""

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        pc, w = standardise(principal(t, 1))[:, 0], standardise(w)
        make = lambda: Boosted(trees, depth, seed=seed)
        theta, se, _ = effect(y - cross_fit(w, y, seed=seed, make=make), pc - cross_fit(w, pc, seed=seed, make=make))
        return {"n": len(y), "theta": theta, "se": se, "ci_low": theta - 1.96 * se, "ci_high": theta + 1.96 * se}

    return per_group(df, ["city"], work, "city string, n long, theta double, se double, ci_low double, ci_high double")


def doubly_robust_fit(t: np.ndarray, w: np.ndarray, y: np.ndarray, trees: int, depth: int, resamples: int, seed: int) -> dict:
    norm = np.linalg.norm(principal(t, min(50, t.shape[1], len(t) - 1)), axis=1)
    d, w = (norm > np.median(norm)).astype(float), standardise(w)
    model = Boosted(trees, depth, seed=seed).fit(np.column_stack([d, w]), y)
    e = np.clip(probability(logistic(w, d), w), 0.05, 0.95)
    m1, m0 = (model.predict(np.column_stack([np.full(len(y), v), w])) for v in (1.0, 0.0))
    psi = m1 - m0 + d * (y - m1) / e - (1 - d) * (y - m0) / (1 - e)
    rng = np.random.default_rng(seed)
    boot = np.array([psi[rng.integers(0, len(psi), len(psi))].mean() for _ in range(resamples)])
    se = float(np.sqrt(psi.var(ddof=1) / len(psi)))
    return {"n": len(y), "ate": float(psi.mean()), "se": se, "boot_low": float(np.quantile(boot, 0.025)), "boot_high": float(np.quantile(boot, 0.975)), "mde": 2.8 * se}


def doubly_robust_by_city(df: DataFrame, trees: int = 60, depth: int = 4, resamples: int = 500, seed: int = 42) -> DataFrame:
    """(city, n, ate, se, boot_low, boot_high, mde): treatment is a norm of components above its median; boosted outcome, logistic propensity."""

    def work(pdf: pd.DataFrame) -> dict:
        return doubly_robust_fit(*_arrays(pdf), trees, depth, resamples, seed)

    return per_group(df, ["city"], work, "city string, n long, ate double, se double, boot_low double, boot_high double, mde double")


def by_outcome_segment(df: DataFrame, segments: int = 4, least: int = 30, seed: int = 42) -> DataFrame:
    """(city, segment, n, ate, se, boot_low, boot_high, mde): the same within quantile segments of the outcome, left-closed; small or uniform segments have nulls.

    Segments of the outcome itself select on what follows the treatment; quantile_cells() on out-of-fold predictions does not.
    """
    edges = df.groupBy("city").agg(F.percentile("y", F.array(*[F.lit(i / segments) for i in range(1, segments)])).alias("_e"))
    placed = df.join(edges, "city").withColumn("segment", F.size(F.filter("_e", lambda e: e <= F.col("y")))).drop("_e")

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        if len(y) < least or y.std() == 0:
            return {"n": len(y), **dict.fromkeys(("ate", "se", "boot_low", "boot_high", "mde"), None)}
        return doubly_robust_fit(t, w, y, 50, 3, 300, seed + int(pdf["segment"].iloc[0]))

    return per_group(placed, ["city", "segment"], work, "city string, segment int, n long, ate double, se double, boot_low double, boot_high double, mde double")


def r2(y: np.ndarray, p: np.ndarray) -> float:
    return float(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def backdoor_gain(df: DataFrame, seed: int = 42) -> DataFrame:
    """(city, n, r2_w, r2_w_emb, gain, unique_emb, unique_w, shared): cross-validated R2 of the outcome on confounders, on embeddings, and on both."""

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        pcs, w = principal(t, min(20, t.shape[1])), standardise(w)
        make = lambda: Boosted(**QUICK, sample=0.8, seed=seed)
        a, b, c = (r2(y, cross_fit(x, y, seed=seed, make=make)) for x in (w, np.column_stack([w, pcs]), pcs))
        return {"n": len(y), "r2_w": a, "r2_w_emb": b, "gain": b - a, "unique_emb": b - a, "unique_w": b - c, "shared": max(0.0, a + c - b)}

    return per_group(df, ["city"], work, "city string, n long, r2_w double, r2_w_emb double, gain double, unique_emb double, unique_w double, shared double")


def _draws(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n))))


def randomization(df: DataFrame, draws: int = 20, seed: int = 42) -> DataFrame:
    """(city, r2, p, draws): R2 with the confounders' rows permuted against that as they are; a draw to a task. p counts draws at least as good, without adding one."""

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        k = int(pdf["draw"].iloc[0])
        w = standardise(w)
        w = w if k == 0 else w[np.random.default_rng(seed + k).permutation(len(w))]
        return {"r2": r2(y, cross_fit(w, y, seed=seed, make=lambda: Boosted(**QUICK, sample=0.8, seed=seed)))}

    fits = per_group(_draws(df, draws), ["city", "draw"], work, "city string, draw int, r2 double")
    own = fits.where("draw = 0").select("city", F.col("r2").alias("own"))
    return fits.join(own, "city").where("draw > 0").groupBy("city").agg(F.first("own").alias("r2"), F.avg((F.col("r2") >= F.col("own")).cast("double")).alias("p"), F.count("*").alias("draws"))


def placebos(df: DataFrame, draws: int = 20, seed: int = 42) -> DataFrame:
    """(city, draw, kind, theta, se): the effect with embeddings permuted at random and within labels; draw 0 is the estimate itself. One task each."""
    kinds = F.explode(F.array(F.lit("random"), F.lit("within_label")))

    def work(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("id")
        t, w, y = _arrays(pdf)
        k, rng = int(pdf["draw"].iloc[0]), np.random.default_rng(seed + int(pdf["draw"].iloc[0]))
        at = np.arange(len(y))
        if k and pdf["kind"].iloc[0] == "random":
            at = rng.permutation(len(y))
        elif k:
            for _, rows in pd.Series(np.arange(len(y))).groupby(pdf["label"].fillna("").to_numpy()):
                at[rows] = rng.permutation(rows.to_numpy())
        pc, w = standardise(principal(t[at], 1))[:, 0], standardise(w)
        make = lambda: Boosted(**QUICK, seed=seed)
        theta, se, _ = effect(y - cross_fit(w, y, seed=seed, make=make), pc - cross_fit(w, pc, seed=seed, make=make))
        return {"theta": theta, "se": se}

    return per_group(_draws(df, draws).withColumn("kind", kinds), ["city", "draw", "kind"], work, "city string, draw int, kind string, theta double, se double")


def calibrated(fits: DataFrame) -> list[dict]:
    """For each city and kind, the estimate calibrated by its placebos; fits are a few rows a city."""
    rows, out = fits.collect(), []
    for city, kind in sorted({(r["city"], r["kind"]) for r in rows}):
        some = [r for r in rows if (r["city"], r["kind"]) == (city, kind)]
        own = next(r for r in some if r["draw"] == 0)
        out.append({"city": city, "kind": kind, **calibrate([(r["theta"], r["se"]) for r in some if r["draw"]], own["theta"], own["se"])})
    return out


def seed_stability(df: DataFrame, seeds: int = 10) -> DataFrame:
    """(city, seeds, median, mean, sd, low, high) of the effect over seeds of folds and learners, a seed to a task."""

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        s = int(pdf["draw"].iloc[0])
        pc, w = standardise(principal(t, 1))[:, 0], standardise(w)
        make = lambda: Boosted(**QUICK, sample=0.8, seed=s)
        return {"theta": effect(y - cross_fit(w, y, seed=s, make=make), pc - cross_fit(w, pc, seed=s, make=make))[0]}

    fits = per_group(_draws(df, seeds - 1), ["city", "draw"], work, "city string, draw int, theta double")
    return fits.groupBy("city").agg(F.count("*").alias("seeds"), F.median("theta").alias("median"), F.avg("theta").alias("mean"), F.stddev_samp("theta").alias("sd"), F.min("theta").alias("low"), F.max("theta").alias("high"))


def escalation(df: DataFrame, names: list[str], seed: int = 42, last_all: bool = False) -> DataFrame:
    """(city, level, n_confounders, ate, se): the doubly robust effect with more and more confounders, from none to all; a level to a task. last_all: only none and all."""
    levels = df.withColumn("level", F.explode(F.array(F.lit(0), F.size("w")) if last_all else F.sequence(F.lit(0), F.lit(len(names)))))

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        k = int(pdf["level"].iloc[0])
        got = doubly_robust_fit(t, w[:, :k] if k else np.zeros((len(y), 1)), y, 40, 3, 100, seed)
        return {"n_confounders": k, "ate": got["ate"], "se": got["se"]}

    return per_group(levels, ["city", "level"], work, "city string, level int, n_confounders int, ate double, se double")


def ridge(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    c, m = x - x.mean(axis=0), y.mean()
    b = np.linalg.solve(c.T @ c + strength * np.eye(x.shape[1]), c.T @ (y - m))
    return b, float(m - x.mean(axis=0) @ b)


def transfer(df: DataFrame, components_kept: int = 10) -> DataFrame:
    """(source, target, r2, r2_centred, spearman): a model of one city's outcomes on shared components scored on another's.

    A model a city is fitted in a task and sent to all; cities are few.
    """
    shared = components(df, components_kept)

    def work(pdf: pd.DataFrame) -> dict:
        x, y = np.vstack(pdf["pcs"]), pdf["y"].to_numpy(float)
        b, a = ridge(x, y)
        return {"beta": b.tolist(), "alpha": a}

    models = per_group(shared.select("city", "pcs", "y"), ["city"], work, "city string, beta array<double>, alpha double").withColumnRenamed("city", "source")
    scored = shared.crossJoin(F.broadcast(models))  # a row a city
    fit = F.col("alpha") + F.aggregate(F.zip_with("pcs", "beta", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    scored = scored.select("source", F.col("city").alias("target"), "y", fit.alias("p"))

    def score(pdf: pd.DataFrame) -> dict:
        y, p = pdf["y"].to_numpy(float), pdf["p"].to_numpy(float)
        return {"r2": r2(y, p), "r2_centred": r2(y - y.mean(), p - p.mean()), "spearman": float(pdf["y"].rank().corr(pdf["p"].rank()))}

    return per_group(scored, ["source", "target"], score, "source string, target string, r2 double, r2_centred double, spearman double")


def label_accuracy(df: DataFrame, least: int = 5, k: int = 5, seed: int = 42, most: int = MOST_ROWS) -> DataFrame:
    """(city, classes, accuracy, baseline, sum_of_squares, majority): cross-validated accuracy of labels from components, by a softmax regression; labels with fewer than ``least`` rows left out.

    A city to a task; the rows of a city of more than ``most`` are spread over tasks.
    """
    schema = "city string, classes long, accuracy double, baseline double, sum_of_squares double, majority double"
    large = [r["city"] for r in df.groupBy("city").count().where(F.col("count") > most).collect()]  # few, as each has that many rows
    if large:
        few = [c for c in large if c is not None]
        small = df.where(~F.coalesce(F.col("city").isin(few), F.lit(False)) if few else F.lit(True)).where(F.lit(None not in large) | F.col("city").isNotNull())
        rows = [(c, *_spread_label_accuracy(df.where(F.col("city").eqNullSafe(F.lit(c))), least, k, seed)) for c in large]
        return label_accuracy(small, least, k, seed, 2**62).unionAll(df.sparkSession.createDataFrame(rows, schema))

    def work(pdf: pd.DataFrame) -> dict:
        pdf = pdf[pdf["label"].notna()].sort_values("id")
        pdf = pdf[pdf.groupby("label")["id"].transform("size") >= least]
        names, y = np.unique(pdf["label"].to_numpy(str), return_inverse=True)
        if len(names) < 2:
            return {"classes": len(names), **dict.fromkeys(("accuracy", "baseline", "sum_of_squares", "majority"), None)}
        t = np.vstack(pdf["emb"])
        x, at, hits = standardise(principal(t, min(50, t.shape[1], len(t) - 1))), folds_of(len(y), k, seed), 0
        for f in range(k):
            net, rows = Network([x.shape[1], len(names)], seed), at != f
            for _ in range(120):
                g = softmax(net.forward(x[rows]))
                g[np.arange(len(g)), y[rows]] -= 1
                net.backward(g / rows.sum(), 0.05, 1e-3)
            hits += (net.forward(x[~rows]).argmax(axis=1) == y[~rows]).sum()
        share = np.bincount(y) / len(y)
        return {"classes": len(names), "accuracy": float(hits / len(y)), "baseline": 1 / len(names), "sum_of_squares": float((share**2).sum()), "majority": float(share.max())}

    return per_group(df, ["city"], work, schema)


def _spread_label_accuracy(df: DataFrame, least: int, k: int, seed: int, steps: int = 120, block: int = 2048) -> tuple:
    """What label_accuracy() tells of one city, (classes, accuracy, baseline, sum_of_squares, majority), its rows spread over tasks.

    The same model and steps, but folds come from a hash of the id. Components come from sums of products, and a step's gradients are sums over rows,
    of all folds at once; rows are kept in blocks of scores. A label's name and count, and a few thousand numbers a task and step, go to the driver.
    """
    rows = df.where("label is not null")
    counts = sorted((r["label"], r["count"]) for r in rows.groupBy("label").count().where(F.col("count") >= least).collect())
    c, n = len(counts), sum(m for _, m in counts)
    if c < 2:
        return c, None, None, None, None
    scratch, place, share = Scratch(df.sparkSession), {name: i for i, (name, _) in enumerate(counts)}, np.array([m for _, m in counts]) / n
    kept = rows.select("label", "emb", fold(F.col("id"), k, seed).cast("long").alias("fold"))

    def summed(df: DataFrame, work: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
        """The sum over batches of what work makes of each, in one array."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = 0.0
            for pdf in batches:
                if len(pdf):
                    out = out + work(pdf)
            if not np.isscalar(out):
                yield pd.DataFrame({"s": [out.astype("<f8").tobytes()]})

        return np.sum([np.frombuffer(r["s"], "<f8") for r in df.mapInPandas(run, "s binary").collect()], axis=0)

    def vectors(pdf: pd.DataFrame) -> np.ndarray:
        return np.vstack(pdf["emb"][pdf["label"].isin(place)].tolist() or np.zeros((0, len(pdf["emb"].iloc[0]))))

    mean = summed(kept, lambda pdf: vectors(pdf).sum(axis=0)) / n

    def products(pdf: pd.DataFrame) -> np.ndarray:
        t = vectors(pdf) - mean
        return (t.T @ t).ravel()

    value, load = np.linalg.eigh(summed(kept, products).reshape(len(mean), len(mean)))
    p = min(50, len(mean), n - 1)
    value, load = value[::-1][:p], load[:, ::-1][:, :p]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(p)])
    load = load / np.where(value > 1e-12 * value[0], np.sqrt(np.maximum(value, 1e-300) / n), np.inf)  # scores with a deviation of 1; 0 where there is none

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["label"].isin(place)].sort_values("fold", kind="stable")
            for i in range(0, len(pdf), block):
                part = pdf.iloc[i : i + block]
                x, y = (np.vstack(part["emb"]) - mean) @ load, part["label"].map(place).to_numpy("<i8")
                yield pd.DataFrame({"x": [x.astype("<f8").tobytes()], "y": [y.tobytes()], "at": [part["fold"].to_numpy("<i8").tobytes()]})

    table = scratch.cut(kept.mapInPandas(blocks, "x binary, y binary, at binary"))

    def read(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for x, y, at in zip(pdf["x"], pdf["y"], pdf["at"]):
            yield np.frombuffer(x, "<f8").reshape(-1, p), np.frombuffer(y, "<i8"), np.frombuffer(at, "<i8")

    def gradients(pdf: pd.DataFrame) -> np.ndarray:
        """For each fold, of the rows that aren't in it: sums for weights and biases, then the number of rows."""
        out = np.zeros((k, p * c + c + 1))
        for x, y, at in read(pdf):
            for f, (w, b) in enumerate(weights):
                rows = at != f
                own, g = x[rows], y[rows]
                z = softmax(own @ w + b)
                z[np.arange(len(z)), g] -= 1
                out[f] += np.concatenate([(own.T @ z).ravel(), z.sum(axis=0), [len(z)]])
        return out.ravel()

    def hits(pdf: pd.DataFrame) -> np.ndarray:
        return np.array([sum(float(((x[at == f] @ w + b).argmax(axis=1) == y[at == f]).sum()) for x, y, at in read(pdf) for f, (w, b) in enumerate(weights))])

    nets = [Network([p, c], seed) for _ in range(k)]
    for _ in range(steps):
        weights = [(net.w[0], net.b[0]) for net in nets]
        for net, s in zip(nets, summed(table, gradients).reshape(k, -1)):
            if s[-1]:
                net.step([s[: p * c].reshape(p, c) / s[-1]], [s[p * c : -1] / s[-1]], 0.05, 1e-3)
    weights = [(net.w[0], net.b[0]) for net in nets]
    accuracy = float(summed(table, hits)[0] / n)
    scratch.drop(table)
    return c, accuracy, 1 / c, float((share**2).sum()), float(share.max())


def deconfounded(df: DataFrame, epochs: int = 60, seed: int = 0) -> DataFrame:
    """(city, n, label_acc, label_probe_acc, baseline, geo_r2): an encoder trained to predict the outcome while a discriminator, whose gradient
    is reversed, tries to tell labels and place from its code; a probe of the frozen code then shows what is left. A city to a task."""

    def work(pdf: pd.DataFrame) -> dict:
        pdf = pdf[pdf["label"].notna()].sort_values("id")
        t, _, y = _arrays(pdf)
        names, lab = np.unique(pdf["label"].to_numpy(str), return_inverse=True)
        x, y, geo = standardise(t), (y - y.mean()) / (y.std() or 1), standardise(pdf[["lat", "lon"]].to_numpy(float))
        n, c = len(y), len(names)
        train = np.random.default_rng(seed).random(n) < 0.7
        enc, head, disc = Network([x.shape[1], 64, 32], seed), Network([32, 1], seed + 1), Network([32, 32, c + 2], seed + 2)
        one_hot = np.eye(c)[lab[train]]
        for epoch in range(epochs):
            lam = 0.1 + 0.9 * min(1.0, max(0.0, (epoch - epochs / 15) / (epochs / 4)))
            code = enc.forward(x[train], last_linear=False)
            err = head.forward(code)[:, 0] - y[train]
            g = head.backward(2 * err[:, None] / train.sum(), 1e-3, 1e-4)
            z = disc.forward(code)
            d = np.column_stack([(softmax(z[:, :c]) - one_hot), 2 * (z[:, c:] - geo[train])]) / train.sum() / 2
            g = g - lam * disc.backward(d, 1e-3, 1e-4)
            enc.backward(g, 1e-3, 1e-4, last_linear=False)
        code = enc.forward(x, last_linear=False)
        live = (disc.forward(code[~train])[:, :c].argmax(axis=1) == lab[~train]).mean()
        z, probe = standardise(code), Network([32, c], seed)
        for _ in range(150):
            probe.backward((softmax(probe.forward(z[train])) - one_hot) / train.sum(), 0.05, 1e-3)
        acc = (probe.forward(z[~train]).argmax(axis=1) == lab[~train]).mean()
        fits = [ridge(z[train], geo[train, j]) for j in range(2)]
        geo_r2 = float(np.mean([r2(geo[~train, j], z[~train] @ b + a) for j, (b, a) in enumerate(fits)]))
        return {"n": n, "label_acc": float(live), "label_probe_acc": float(acc), "baseline": 1 / c, "geo_r2": geo_r2}

    return per_group(df, ["city"], work, "city string, n long, label_acc double, label_probe_acc double, baseline double, geo_r2 double")


def capacity_ladder(spark, n: int = 1500, trials: int = 3) -> DataFrame:
    """(rung, trial, bits): what probes of growing capacity find of a label that is the exclusive or of two signs; a linear one finds nothing. A rung and trial to a task."""
    rungs = spark.createDataFrame([(i, t) for i in range(4) for t in range(trials)], "rung int, trial int").repartition(4 * trials, "rung", "trial")

    def work(pdf: pd.DataFrame) -> dict:
        rung, trial = int(pdf["rung"].iloc[0]), int(pdf["trial"].iloc[0])
        rng = np.random.default_rng(100 * rung + trial)
        x = rng.normal(size=(n, 2))
        y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
        train = np.arange(n) < n // 2
        net = Network([2, *[[], [4], [16], [32, 32]][rung], 2], trial)
        one_hot = np.eye(2)[y[train]]
        for _ in range(400):
            net.backward((softmax(net.forward(x[train])) - one_hot) / train.sum(), 0.02)
        p = y[~train].mean()
        h = -(p * np.log(p) + (1 - p) * np.log(1 - p))
        return {"nats": float(max(0.0, h - cross_entropy(net.forward(x[~train]), y[~train])))}

    return per_group(rungs, ["rung", "trial"], work, "rung int, trial int, nats double")


def monte_carlo(spark, sizes: list[int], effects: list[float], reps: int, seed: int = 1) -> DataFrame:
    """(n, truth, rep, estimator, theta, se, ci_low, ci_high): replicates of a known partially linear model, a replicate to a task. A failed one has nulls and keeps its cell."""
    cells = [(n, e, r) for n in sizes for e in effects for r in range(reps)]
    grid = spark.createDataFrame(cells, "n int, truth double, rep int").repartition(min(len(cells), 64), "n", "truth", "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, truth, rep = int(pdf["n"].iloc[0]), float(pdf["truth"].iloc[0]), int(pdf["rep"].iloc[0])
        rng = np.random.default_rng([seed, n, int(truth * 1000), rep])
        z = rng.uniform(-1, 1, n)
        w = np.column_stack([np.sin(3 * z), np.cos(2 * z), np.tanh(2 * z), z**2, z]) + 0.3 * rng.normal(size=(n, 5))
        t = np.sin(2 * z) + 0.7 * rng.normal(size=n)
        y = truth * t + np.exp(z) + 0.5 * rng.normal(size=n)
        rows = []
        for name in ("linear", "boosted"):
            try:
                if name == "linear":
                    at, hat = folds_of(n, 5, rep), np.zeros((2, n))
                    for f in range(5):
                        for j, v in enumerate((y, t)):
                            b, a = ridge(w[at != f], v[at != f], 1e-6)
                            hat[j, at == f] = w[at == f] @ b + a
                else:
                    make = lambda: Boosted(**QUICK, seed=rep)
                    hat = np.stack([cross_fit(w, v, seed=rep, make=make) for v in (y, t)])
                theta, se, _ = effect(y - hat[0], t - hat[1])
                rows.append((n, truth, rep, name, theta, se, theta - 1.96 * se, theta + 1.96 * se))
            except np.linalg.LinAlgError:
                rows.append((n, truth, rep, name, None, None, None, None))
        return pd.DataFrame(rows, columns=["n", "truth", "rep", "estimator", "theta", "se", "ci_low", "ci_high"])

    return grid.groupBy("n", "truth", "rep").applyInPandas(run, "n int, truth double, rep int, estimator string, theta double, se double, ci_low double, ci_high double")


def pair_distances(t: np.ndarray, g: np.ndarray, block: int = 200) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distances in space and cosine distances between embeddings of all pairs of rows, in blocks of rows against those after them."""
    u = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
    for s in range(0, len(t) - 1, block):
        rows = u[s : s + block]
        later = np.arange(s, len(t))[None, :] > np.arange(s, s + len(rows))[:, None]
        space = np.sqrt((g[s : s + block, :1] - g[s:, 0]) ** 2 + (g[s : s + block, 1:] - g[s:, 1]) ** 2)
        yield space[later], (1 - rows @ u[s:].T)[later]


def _ranks(values: np.ndarray, ordered: np.ndarray, before: int) -> np.ndarray:
    """Mean ranks of values, all in ordered, which has ``before`` smaller ones ahead of it."""
    return before + (np.searchsorted(ordered, values, "left") + np.searchsorted(ordered, values, "right") + 1) / 2


def spatial_rank_correlation(df: DataFrame, most: int = 10_000, seed: int = 42, ranges: int = 4) -> DataFrame:
    """(city, pairs, rho): rank correlation of distances in space and between embeddings over all pairs of at most about ``most`` rows, a hash sample, of a city.

    The sample is part of the measure: pairs grow with its square. The ranks are exact: a task has a range of either distance, of
    ``ranges`` by ``ranges``, goes over all pairs of the city in blocks, and ranks those in its ranges; no pair is shuffled or kept outside them.
    """
    from lotweave.operators.estimate import hash_number

    threshold = df.groupBy("city").agg(F.count("*").alias("_n"))
    some = df.join(threshold, "city").where(hash_number(F.col("id"), seed) < F.lit(16**8) * F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n")))
    each = F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))
    cells = some.select("city", "id", "emb", "lat", "lon").withColumn("a", each).withColumn("b", each)
    cells = cells.repartition(8 * ranges * ranges, "city", "a", "b")  # by number, or adaptive execution would put the cells, small as they are, in one task

    def work(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("id")
        at, t, g = (int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])), np.vstack(pdf["emb"]), pdf[["lat", "lon"]].to_numpy(float)
        few = np.linspace(0, len(t) - 1, min(len(t), 400)).astype(int)
        first = list(pair_distances(t[few], g[few])) or [(np.zeros(0), np.zeros(0))]
        edges = []  # that the ranges are about equal saves memory, and is no matter to the ranks
        for j in range(2):
            v = np.concatenate([x[j] for x in first])
            edges.append(np.concatenate([[-np.inf], np.quantile(v, np.arange(1, ranges) / ranges) if len(v) else np.zeros(ranges - 1), [np.inf]]))
        lo, hi = ([edges[j][at[j] + d] for j in range(2)] for d in (0, 1))
        before, own, both, n = [0, 0], ([], []), ([], []), 0
        for pair in pair_distances(t, g):
            inside = [(x >= lo[j]) & (x < hi[j]) for j, x in enumerate(pair)]
            n += len(pair[0])
            for j, x in enumerate(pair):
                before[j] += int((x < lo[j]).sum())
                own[j].append(x[inside[j]])
                both[j].append(x[inside[0] & inside[1]])
        ranks, squares = [], []
        for j in range(2):
            ordered = np.concatenate(own[j]) if own[j] else np.zeros(0)
            own[j].clear()
            ordered.sort()
            ranks.append(_ranks(np.concatenate(both[j]) if both[j] else np.zeros(0), ordered, before[j]) - (n + 1) / 2)
            parts = np.array_split(ordered, len(ordered) // 1_000_000 + 1) if at[1 - j] == 0 else []
            squares.append(float(sum(((_ranks(p, ordered, before[j]) - (n + 1) / 2) ** 2).sum() for p in parts)))
        return {"pairs": n, "ab": float(ranks[0] @ ranks[1]), "aa": squares[0], "bb": squares[1]}

    sums = per_group(cells, ["city", "a", "b"], work, "city string, a int, b int, pairs long, ab double, aa double, bb double")
    sums = sums.groupBy("city").agg(F.first("pairs").alias("pairs"), *[F.sum(c).alias(c) for c in ("ab", "aa", "bb")])
    root = F.sqrt("aa") * F.sqrt("bb")
    return sums.select("city", "pairs", F.when(root > 0, F.col("ab") / root).alias("rho"))


def report(df: DataFrame, trees: int = 40, depth: int = 3, resamples: int = 200, k: int = 20, most_pairs: int = 5_000) -> DataFrame:
    """One row a city: mutual information of clusters and labels, label accuracy against chance, rank correlation with space, R2 gain, the doubly robust effect, and a verdict.

    Each part is a row a city; they are put together by a join.
    """
    acc = label_accuracy(df).select("city", "classes", "accuracy", "baseline")
    gain = backdoor_gain(df).select("city", "gain")
    space = spatial_rank_correlation(df, most_pairs).select("city", "rho")
    dr = doubly_robust_by_city(df, trees, depth, resamples)
    nmi = [cluster_label_nmi(df.where(F.col("city") == c), k, 1).select(F.lit(c).alias("city"), "nmi") for (c,) in df.select("city").where("city is not null").distinct().orderBy("city").collect()]  # cities are few
    told = nmi[0]
    for n in nmi[1:]:
        told = told.unionAll(n)
    size = df.groupBy("city").agg(F.max(F.size("emb")).alias("embedding_dim"))
    out = dr.join(told, "city").join(acc, "city").join(gain, "city").join(space, "city").join(size, "city")
    ratio = F.coalesce(F.try_divide("accuracy", "baseline"), F.lit(0.0))
    zero = (F.col("boot_low") <= 0) & (F.col("boot_high") >= 0)
    grade = F.when((F.col("nmi") > 0.4) & (ratio > 5) & zero, "severe").when((F.col("nmi") > 0.2) & (ratio > 2), "high").when(F.col("nmi") > 0.1, "moderate").otherwise("low")
    return out.select("city", "n", "embedding_dim", "classes", "nmi", F.col("accuracy").alias("label_accuracy"), F.col("baseline").alias("random_baseline"), ratio.alias("accuracy_ratio"), F.col("rho").alias("spatial_rho"), F.col("gain").alias("r2_gain"), "ate", F.col("boot_low").alias("ci_low"), F.col("boot_high").alias("ci_high"), zero.alias("contains_zero"), grade.alias("severity"))


def heterogeneity_p(wald: float, df: int) -> float:
    return chi2_sf(wald, df) if df > 0 else float("nan")


def _resid(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    b, a = ridge(x, v)
    return v - (x @ b + (a if v.ndim == 1 else v.mean(axis=0) - x.mean(axis=0) @ b))


def _rank_rows(v: np.ndarray) -> np.ndarray:
    """Mean ranks of each column, centred and of length 1; zeros for a constant column."""
    r = pd.DataFrame(v).rank().to_numpy()
    r -= r.mean(axis=0)
    n = np.linalg.norm(r, axis=0)
    return r / np.where(n > 0, n, 1.0)


def independence(df: DataFrame, bins: int = 20, permutations: int = 200, most: int = 30, of_null: int = 10) -> DataFrame:
    """(city, level, conf_dim, mean_rho, max_rho, p): whether outcome and text are independent given the label alone, and given all confounders.

    Residuals of ridge regressions on the confounders; the mean absolute rank correlation over components is held against that of permuted outcomes over
    the first ``of_null`` components. p counts the permutations at least as large, with one added to both. A city and level to a task.
    """
    levels = df.withColumn("level", F.explode(F.array(F.lit("label"), F.lit("rich"))))

    def work(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("id")
        t, w, y = _arrays(pdf)
        if pdf["level"].iloc[0] == "label":
            codes = pd.factorize(pdf["label"].fillna(""), sort=True)[0] % bins
            w = np.eye(bins)[codes][:, np.unique(codes)]
        w, pcs = standardise(w), standardise(principal(t, min(most, t.shape[1], len(t) - 2)))
        rest_y, rest_t = _rank_rows(_resid(w, y)[:, None])[:, 0], _rank_rows(np.column_stack([_resid(w, pcs[:, j]) for j in range(pcs.shape[1])]))
        rho = np.abs(rest_y @ rest_t)
        null = np.array([np.abs(rest_y[np.random.default_rng(k).permutation(len(y))] @ rest_t[:, :of_null]).mean() for k in range(permutations)])
        return {"conf_dim": w.shape[1], "mean_rho": float(rho.mean()), "max_rho": float(rho.max()), "p": float(((null >= rho.mean()).sum() + 1) / (permutations + 1))}

    return per_group(levels, ["city", "level"], work, "city string, level string, conf_dim long, mean_rho double, max_rho double, p double")


def regression_sensitivity(df: DataFrame) -> DataFrame:
    """(city, n, tau, se, t, r2_full, r2_rest, partial_r2, robustness): a regression of the outcome on a text norm above its median and the confounders, and how strong a confounder must be to explain it."""

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        norm = np.linalg.norm(standardise(principal(t, min(20, t.shape[1], len(t) - 2))), axis=1)
        d, n = (norm > np.median(norm)).astype(float), len(y)
        fits = []
        for x in (np.column_stack([np.ones(n), d, w]), np.column_stack([np.ones(n), w])):
            b = np.linalg.lstsq(x, y, rcond=None)[0]
            fits.append((b, r2(y, x @ b), y - x @ b))
        (b, full, rest), bare = fits[0], fits[1][1]
        se = float(np.sqrt((rest**2).sum() / (n - 1 - w.shape[1])) / np.sqrt(((d - d.mean()) ** 2).sum()))
        tau = float(b[1])
        return {"n": n, "tau": tau, "se": se, "t": tau / se if se else None, "r2_full": full, "r2_rest": bare, "partial_r2": (full - bare) / (1 - bare) if bare < 1 else None, "robustness": regression_robustness(tau, se)}

    return per_group(df, ["city"], work, "city string, n long, tau double, se double, t double, r2_full double, r2_rest double, partial_r2 double, robustness double")


def model_verdicts(df: DataFrame, components_kept: int = 10) -> DataFrame:
    """(city, own_r2, carried_r2, bare, adjusted, portability, stability, verdict): how a city's model does elsewhere, how an effect shrinks under confounders, and which causal model both speak for. Three results of a row a city are put together on the driver."""
    moved = transfer(df, components_kept).collect()  # a row a pair of cities
    levels = escalation(df.select("city", "id", "emb", "y", "label", "lat", "lon", "w"), ["bare", "all"], last_all=True).collect()
    rows = []
    for city in sorted({r["source"] for r in moved}):
        own = next(r["r2"] for r in moved if r["source"] == city == r["target"])
        others = [r["r2"] for r in moved if r["source"] == city != r["target"]]
        carried = float(np.mean(others)) if others else own
        bare, adjusted = (next(r["ate"] for r in levels if r["city"] == city and (r["n_confounders"] > 0) == k) for k in (False, True))
        port, stable = portability(own, carried), stability(bare, adjusted)
        rows.append((city, own, carried, bare, adjusted, port, stable, verdict(port, stable)))
    return df.sparkSession.createDataFrame(rows, "city string, own_r2 double, carried_r2 double, bare double, adjusted double, portability string, stability string, verdict string")


def embedding_effects(df: DataFrame, vectors: list[str]) -> DataFrame:
    """(model, city, n, theta, se, ci_low, ci_high): the effect with each of several embeddings of the same texts, a model and city to a task; a model's vectors may be of any size."""
    parts = [df.withColumn("emb", F.transform(v, lambda x: x.cast("double"))).withColumn("model", F.lit(v)).select("model", "city", "id", "emb", "w", "y") for v in vectors]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        pc, w = standardise(principal(t, 1))[:, 0], standardise(w)
        make = lambda: Boosted(**QUICK)
        theta, se, _ = effect(y - cross_fit(w, y, make=make), pc - cross_fit(w, pc, make=make))
        return {"n": len(y), "theta": theta, "se": se, "ci_low": theta - 1.96 * se, "ci_high": theta + 1.96 * se}

    return per_group(rows, ["model", "city"], work, "model string, city string, n long, theta double, se double, ci_low double, ci_high double")


def ablation(df: DataFrame, whole: str, ablated: str, k: int = 20) -> DataFrame:
    """(texts, nmi, accuracy): how much labels are in the embeddings of whole texts and of texts without place names; df has id, city, label and both vectors."""
    out = []
    for name, v in (("whole", whole), ("ablated", ablated)):
        rows = df.withColumn("emb", F.col(v))
        nmi = cluster_label_nmi(rows, k, 1).select("nmi")
        acc = label_accuracy(rows.withColumn("city", F.lit("all")).withColumn("emb", F.transform("emb", lambda x: x.cast("double")))).select("accuracy")
        out.append(nmi.crossJoin(acc).select(F.lit(name).alias("texts"), "nmi", "accuracy"))  # one row each
    return out[0].unionAll(out[1])


def price_models(df: DataFrame, structured: str = "w", vector: str = "emb", k: int = 5, trees: int = 60, depth: int = 4, seed: int = 42) -> DataFrame:
    """(city, model, mae, mae_sd, mape, mape_sd): errors over folds, on the scale of prices, of boosted trees on structured columns and on these with the embedding's components."""
    both = df.withColumn("model", F.explode(F.array(F.lit("structured"), F.lit("with_text"))))

    def work(pdf: pd.DataFrame) -> dict:
        t, w, y = _arrays(pdf)
        x = w if pdf["model"].iloc[0] == "structured" else np.column_stack([w, principal(t, min(20, t.shape[1], len(t) - 1))])
        at, p = folds_of(len(y), k, seed), np.exp(cross_fit(x, y, k, seed, lambda: Boosted(trees, depth, seed=seed)))
        off = np.abs(p - np.exp(y))
        mae, mape = ([float(e[at == f].mean()) for f in range(k) if (at == f).any()] for e in (off, off / np.maximum(np.exp(y), 1.0)))
        return {"mae": float(np.mean(mae)), "mae_sd": float(np.std(mae, ddof=1)), "mape": float(np.mean(mape)), "mape_sd": float(np.std(mape, ddof=1))}

    return per_group(both, ["city", "model"], work, "city string, model string, mae double, mae_sd double, mape double, mape_sd double")


def style_and_embedding(df: DataFrame, style: str, vector: str) -> DataFrame:
    """(city, side, classes, accuracy, baseline): how well labels are told from a text's style and from its embedding."""
    parts = [label_accuracy(df.withColumn("emb", F.transform(c, lambda x: x.cast("double")))).select("city", F.lit(side).alias("side"), "classes", "accuracy", "baseline") for side, c in (("style", style), ("embedding", vector))]
    return parts[0].unionAll(parts[1])
