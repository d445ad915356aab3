"""Confounder-adjusted effects, their heterogeneity and sensitivity, from one-pass moments."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotweave.functions.numeric import Z95, Z_POWER80
from lotweave.operators.ranking import global_rank
from lotweave.session import Scratch


def hash_number(key: Column, seed: int, digits: int = 8) -> Column:
    """A number that looks random, from md5 of key and seed, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, digits), 16, 10).cast("bigint")


def fold(key: Column, k: int = 5, seed: int = 42) -> Column:
    return F.pmod(hash_number(key, seed), F.lit(k)).cast("int")


def z_score(df: DataFrame, c: str, out: str) -> DataFrame:
    """df with a column less its mean over its population deviation (1 if that is 0)."""
    m = df.agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, (F.col(c) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")  # one row


def residuals_by_group(df: DataFrame, key: str, y: str, t: str, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold, y_res and t_res: what is left of outcome and treatment after the mean of the row's group in the other folds.

    A group with no rows in other folds takes the mean of all rows in other folds. Sums by group and fold are all that is shuffled.
    """
    rows = df.withColumn("fold", fold(F.col(key), k, seed))
    part = rows.groupBy(group, "fold").agg(F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(t).alias("t"))
    g = Window.partitionBy(group)
    every = part.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("y").alias("fy"), F.sum("t").alias("ft"))
    totals = every.agg(F.sum("fn").alias("an"), F.sum("fy").alias("ay"), F.sum("ft").alias("at"))
    other = part.select(group, "fold", *[(F.sum(c).over(g) - F.col(c)).alias(f"o{c}") for c in "nyt"]).join(F.broadcast(every), "fold").crossJoin(F.broadcast(totals))  # k rows; one row
    means = other.select(
        F.col(group).alias("_g"), F.col("fold").alias("_f"), *[F.when(F.col("on") > 0, F.col(f"o{c}") / F.col("on")).otherwise((F.col(f"a{c}") - F.col(f"f{c}")) / (F.col("an") - F.col("fn"))).alias(f"m{c}") for c in "yt"]
    )
    return rows.join(means, F.col(group).eqNullSafe(F.col("_g")) & (F.col("fold") == F.col("_f"))).withColumns({"y_res": F.col(y) - F.col("my"), "t_res": F.col(t) - F.col("mt")}).drop("_g", "_f", "my", "mt")


def moments(df: DataFrame, columns: list[str], by: str | None = None) -> dict:
    """Sums of products of all pairs of columns (with 1 before them), by group or over all, in one pass; the matrices go to the driver."""
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    grouped = df.groupBy(by) if by else df.groupBy()
    rows = grouped.agg(*[F.sum(xs[i] * xs[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect()  # a row for each fold
    out = {}
    for r in rows:
        m = np.zeros((len(xs), len(xs)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
        out[r[by] if by else None] = m
    return out


def linear_residuals(df: DataFrame, key: str, y: str, t: str, w: list[str], k: int = 5, seed: int = 42, ridge: float = 1e-8) -> DataFrame:
    """df with fold, y_hat, y_res and t_res by linear regressions on w fitted on the other folds.

    Moments by fold are summed in one pass; each fold's coefficients come from all moments less its own, and
    residuals are column expressions, so rows are read twice and never shuffled.
    """
    rows = df.withColumn("fold", fold(F.col(key), k, seed))
    by = moments(rows, [*w, y, t], "fold")
    total, p = sum(by.values()), len(w) + 1

    def predict(target: int) -> Column:
        out = None
        for f, own in by.items():
            m = total - own
            scale = np.sqrt(np.maximum(np.diag(m)[:p], 1e-300))
            beta = np.linalg.solve(m[:p, :p] / np.outer(scale, scale) + ridge * np.eye(p), m[:p, target] / scale) / scale
            value = reduce(lambda a, b: a + b, [F.lit(float(b)) * F.col(c).cast("double") for b, c in zip(beta[1:], w)], F.lit(float(beta[0])))
            out = F.when(F.col("fold") == f, value) if out is None else out.when(F.col("fold") == f, value)
        return out if out is not None else F.lit(None).cast("double")

    return rows.withColumn("y_hat", predict(p)).withColumns({"y_res": F.col(y) - F.col("y_hat"), "t_res": F.col(t) - predict(p + 1)})


def partial_linear(res: DataFrame) -> DataFrame:
    """One row (theta, se, ci_low, ci_high, mde, n) from y_res and t_res: the effect of treatment on outcome and its orthogonal score's error; nulls if nothing of the treatment is left.

    The score's variance comes from the same pass: its mean is 0 at theta, and its square is a sum of moments.
    """
    y, t = F.col("y_res"), F.col("t_res")
    s = res.agg(F.count("*").alias("n"), F.avg(t * y).alias("ty"), F.avg(t * t).alias("tt"), F.avg(t * t * y * y).alias("a"), F.avg(t * t * t * y).alias("b"), F.avg(t * t * t * t).alias("c"))
    s = s.withColumn("theta", F.when(F.col("tt") >= 1e-12, F.col("ty") / F.col("tt")))
    square = (F.col("a") - 2 * F.col("theta") * F.col("b") + F.col("theta") ** 2 * F.col("c")) / F.col("tt") ** 2
    s = s.withColumn("se", F.sqrt(square / (F.col("n") - 1)))
    return s.select("theta", "se", (F.col("theta") - Z95 * F.col("se")).alias("ci_low"), (F.col("theta") + Z95 * F.col("se")).alias("ci_high"), ((Z95 + Z_POWER80) * F.col("se")).alias("mde"), "n")


def scores(res: DataFrame, out: str = "psi") -> DataFrame:
    """res with each row's orthogonal score at the estimate (mean 0)."""
    s = res.agg((F.avg(F.col("t_res") * F.col("y_res")) / F.avg(F.col("t_res") ** 2)).alias("_theta"), F.avg(F.col("t_res") ** 2).alias("_tt"))
    return res.crossJoin(F.broadcast(s)).withColumn(out, (F.col("y_res") - F.col("_theta") * F.col("t_res")) * F.col("t_res") / F.col("_tt")).drop("_theta", "_tt")  # one row


def doubly_robust(df: DataFrame, d: str, y: str, mu0: str, mu1: str, e: str) -> DataFrame:
    """One row (ate, se, ci_low, ci_high, mde, n) of augmented inverse propensity weighting; propensities are clipped to [0.05, 0.95]."""
    p = F.least(F.greatest(F.col(e), F.lit(0.05)), F.lit(0.95))
    psi = F.col(mu1) - F.col(mu0) + F.col(d) * (F.col(y) - F.col(mu1)) / p - (1 - F.col(d)) * (F.col(y) - F.col(mu0)) / (1 - p)
    s = df.select(psi.alias("psi")).agg(F.avg("psi").alias("ate"), F.sqrt(F.var_samp("psi") / F.count("*")).alias("se"), F.count("*").alias("n"))
    return s.select("ate", "se", (F.col("ate") - Z95 * F.col("se")).alias("ci_low"), (F.col("ate") + Z95 * F.col("se")).alias("ci_high"), ((Z95 + Z_POWER80) * F.col("se")).alias("mde"), "n")


def quantile_cells(df: DataFrame, by: str, psi: str, bins: int = 4, least: int = 5) -> DataFrame:
    """(cell, n, mean, se, ci_low, ci_high) of the score in each quantile cell of a column: right-closed, equal edges once; small cells left out."""
    known = df.where(F.col(by).isNotNull() & ~F.isnan(by))
    edges = known.agg(F.array_distinct(F.percentile(by, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("_e"))
    placed = known.crossJoin(F.broadcast(edges)).withColumn("cell", F.size(F.filter("_e", lambda e: F.col(by) > e)))  # one row
    out = placed.groupBy("cell").agg(F.count("*").alias("n"), F.avg(psi).alias("mean"), (F.stddev_samp(psi) / F.sqrt(F.count("*"))).alias("se")).where(F.col("n") >= least)
    return out.withColumns({"ci_low": F.col("mean") - Z95 * F.col("se"), "ci_high": F.col("mean") + Z95 * F.col("se")})


def wald(cells: DataFrame) -> DataFrame:
    """One row (wald, df): squared deviations of the cells' means from the grand mean, in their variances."""
    grand = cells.agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_m"))
    return cells.crossJoin(F.broadcast(grand)).agg(F.sum(F.when(F.col("se") > 0, ((F.col("mean") - F.col("_m")) / F.col("se")) ** 2)).alias("wald"), (F.count("*") - 1).alias("df"))  # one row


def bias_scale(res: DataFrame) -> DataFrame:
    """One row (theta, scale, sd_y): the estimate, by how much a confounder's factor is multiplied, and the outcome residual's deviation."""
    s = res.agg((F.avg(F.col("t_res") * F.col("y_res")) / F.avg(F.col("t_res") ** 2)).alias("theta"))
    full = res.crossJoin(F.broadcast(s))  # one row
    return full.agg(F.max("theta").alias("theta"), F.sqrt(F.var_samp(F.col("y_res") - F.col("theta") * F.col("t_res")) / F.var_samp("t_res")).alias("scale"), F.stddev_samp("y_res").alias("sd_y"))


def robustness_columns(df: DataFrame) -> DataFrame:
    """df(theta, scale, sd_y) with rv (the confounder strength that explains theta away) and e_value."""
    a, b = F.col("scale") ** 2, F.col("theta") ** 2
    rr = F.exp(0.91 * F.abs("theta") / F.col("sd_y"))
    return df.withColumns({"rv": F.sqrt(F.least(F.greatest((-b + F.sqrt(b * b + 4 * a * b)) / (2 * a), F.lit(0.0)), F.lit(1.0))), "e_value": rr + F.sqrt(rr * (rr - 1))})


def strongest_covariates(res: DataFrame, w: list[str], top: int = 5) -> DataFrame:
    """(covariate, r2_y, r2_t) of the covariates that explain most of both residuals (by the product), in one pass over unpivoted moments."""
    long = res.select("y_res", "t_res", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in w])).alias("r")).select("y_res", "t_res", "r.*")
    n, x, y, t = F.count("*"), F.col("x"), F.col("y_res"), F.col("t_res")
    s = long.groupBy("covariate").agg(n.alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(x * t).alias("xt"), F.sum(y).alias("y"), F.sum(t).alias("t"), F.sum(y * y).alias("yy"), F.sum(t * t).alias("tt"))
    sxx = F.col("xx") - F.col("x") ** 2 / F.col("n")
    r2 = {k: F.greatest((F.col(f"x{k}") - F.col("x") * F.col(k) / F.col("n")) ** 2 / sxx / F.greatest(F.col(f"{k}{k}"), F.lit(1e-12)), F.lit(0.0)) for k in "yt"}
    return s.where(sxx > 0).select("covariate", r2["y"].alias("r2_y"), r2["t"].alias("r2_t")).orderBy((F.col("r2_y") * F.col("r2_t")).desc(), "covariate").limit(top)


def poisson_weight(key: Column, resample: Column, seed: int = 7) -> Column:
    """How often a row is drawn in a resample: a Poisson(1) number, at most 8, from a hash of key, resample and seed, the same in any engine."""
    u = hash_number(F.concat_ws("#", key.cast("string"), resample.cast("string")), seed, 7) / F.lit(float(16**7))
    cdf, p, out = 0.0, float(np.exp(-1)), None
    for n in range(8):
        cdf += p
        out = F.when(u < cdf, n) if out is None else out.when(u < cdf, n)
        p /= n + 1
    return out.otherwise(8)


def bootstrap_mean(df: DataFrame, key: str, value: str, resamples: int = 200, seed: int = 7, bounds: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """One row (mean, low, high): percentile interval of the mean over resamples with Poisson(1) weights.

    Weights are a hash of key, resample and seed, so any engine draws the same; resamples are summed before the shuffle.
    """
    drawn = df.select(key, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("_k", poisson_weight(F.col(key), F.col("b"), seed))
    means = drawn.groupBy("b").agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit(bounds[0]), F.lit(bounds[1]))).alias("q"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(ends).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row each


def permute(df: DataFrame, key: str, column: str, seed: int, scratch: Scratch, out: str = "permuted") -> DataFrame:
    """df with a column's values dealt out anew to the rows by a hash of key and seed; ranks are exact and distributed."""
    a = global_rank(df, [F.col(key)], scratch, "_r")
    b = global_rank(df.select(key, F.col(column).alias(out)), [hash_number(F.col(key), seed), F.col(key)], scratch, "_r").select("_r", out)
    return a.join(b, "_r").drop("_r")


def permute_within(df: DataFrame, key: str, column: str, stratum: str, seed: int, out: str = "permuted", parts: int = 64) -> DataFrame:
    """As permute(), within strata. Ranks within a stratum come from counts by hash range, so a large stratum is not ranked in one task."""

    def ranked(order: list[Column], bucket: Column, cols: list) -> DataFrame:
        rows = df.select(*cols, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s"), bucket.alias("_b"), F.struct(*order).alias("_o"))
        n = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
        n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        return rows.join(n, ["_s", "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_o"))).drop("_b", "_o", "_before")

    top = 16**8 // parts
    a = ranked([hash_number(F.col(key), 0), F.col(key)], (hash_number(F.col(key), 0) / top).cast("int"), df.columns)
    b = ranked([hash_number(F.col(key), seed), F.col(key)], (hash_number(F.col(key), seed) / top).cast("int"), [F.col(column).alias(out)])
    return a.join(b, ["_s", "_r"]).drop("_s", "_r")


def least_squares(df: DataFrame, xs: list[str], y: str) -> dict:
    """Ordinary least squares with an intercept, and HC3 errors: {name: (coefficient, error)}, n, r2.

    Two passes: moments, then the sandwich of squared residuals over squared leverage gaps, all of it sums.
    """
    m = moments(df, [*xs, y])[None]
    p = len(xs) + 1
    inverse = np.linalg.inv(m[:p, :p])
    beta = inverse @ m[:p, p]
    row = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    fit = reduce(lambda a, b: a + b, [F.lit(float(b)) * x for b, x in zip(beta, row)])
    lever = reduce(lambda a, b: a + b, [F.lit(float(inverse[i, j])) * row[i] * row[j] for i in range(p) for j in range(p)])
    rows = df.select(*[x.alias(f"x{i}") for i, x in enumerate(row)], (((F.col(y) - fit) / (1 - lever)) ** 2).alias("u"))
    s = rows.agg(*[F.sum(F.col("u") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    meat = np.array([[s[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    n = m[0, 0]
    sst = m[p, p] - m[0, p] ** 2 / n
    ssr = m[p, p] - beta @ m[:p, p]
    return {"coefficients": {c: (float(b), float(e)) for c, b, e in zip(["intercept", *xs], beta, se)}, "n": int(n), "r2": float(1 - ssr / sst) if sst else 0.0}


def replicate_summary(df: DataFrame, cell: list[str], truth: str) -> DataFrame:
    """(cell, n_ok, bias, sd, rmse, coverage, ci_length, power) of replicates(theta, se, ci_low, ci_high, truth); failed replicates (missing or NaN) are left out, their cell stays."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in ("theta", "se", "ci_low", "ci_high")])
    v = {c: F.when(ok, F.col(c)) for c in ("theta", "se", "ci_low", "ci_high")}
    t = F.col(truth)
    return df.groupBy(*cell).agg(
        F.count_if(ok).alias("n_ok"),
        F.avg(v["theta"] - t).alias("bias"),
        F.stddev_samp(v["theta"]).alias("sd"),
        F.sqrt(F.avg((v["theta"] - t) ** 2)).alias("rmse"),
        F.avg(F.when(ok, ((v["ci_low"] <= t) & (t <= v["ci_high"])).cast("double"))).alias("coverage"),
        F.avg(v["ci_high"] - v["ci_low"]).alias("ci_length"),
        F.avg(F.when(ok, (F.abs(v["theta"] / F.when(v["se"] > 0, v["se"])) > Z95).cast("double"))).alias("power"),
    )


def fold_errors(df: DataFrame, fold_col: str, actual_log: str, predicted_log: str) -> DataFrame:
    """One row (mae, mape, rmse and their deviations over folds) on the scale of the exponential."""
    a, p = F.exp(actual_log), F.exp(predicted_log)
    by = df.groupBy(fold_col).agg(F.avg(F.abs(p - a)).alias("mae"), F.avg(F.abs(p - a) / F.greatest(a, F.lit(1.0))).alias("mape"), F.sqrt(F.avg((p - a) ** 2)).alias("rmse"))
    return by.agg(*[f(m).alias(n) for m in ("mae", "mape", "rmse") for f, n in ((F.avg, m), (F.stddev_samp, f"{m}_sd"))])


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (mi, h_a, h_b, nmi) of two labels' contingency table; nmi is over the mean entropy."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))

    def entropy(d: DataFrame, out: str) -> DataFrame:
        return d.agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias(out))

    h = [entropy(d, o) for d, o in ((t, "h_ab"), (t.groupBy(a).agg(F.sum("n").alias("n")), "h_a"), (t.groupBy(b).agg(F.sum("n").alias("n")), "h_b"))]
    out = h[0].crossJoin(h[1]).crossJoin(h[2]).withColumn("mi", F.greatest(F.col("h_a") + F.col("h_b") - F.col("h_ab"), F.lit(0.0)))  # one row each
    return out.select("mi", "h_a", "h_b", F.when(F.col("h_a") + F.col("h_b") > 0, 2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))).otherwise(1.0).alias("nmi"))


def index_bootstrap(df: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 42, bounds: tuple[float, float] = (0.025, 0.975), most: int = 100_000) -> DataFrame:
    """One row (mean, low, high): percentile interval of the mean over resamples of row numbers, n of n with replacement; a resample to a task.

    The values are shared with all tasks, so more than ``most`` are refused; bootstrap_mean() takes any number.
    """
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("v")).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values; use bootstrap_mean()")
    shared, n = spark.sparkContext.broadcast(np.array([r["v"] for r in rows])), len(rows)  # at most ``most`` numbers

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [float(shared.value[np.random.default_rng([seed, int(b)]).integers(0, n, n)].mean()) if n else None for b in pdf["id"]]
            yield pd.DataFrame({"m": pd.Series(out, dtype="float64")})

    means = spark.range(resamples, numPartitions=min(resamples, 64)).mapInPandas(run, "m double")
    ends = means.agg(F.percentile("m", F.array(F.lit(bounds[0]), F.lit(bounds[1]))).alias("q"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(ends).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row each


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1 such that each stratum's rows, in the order of a hash, are dealt out in turn; folds of a stratum differ by a row at most. Ranks are exact over hash ranges; null strata are one."""
    h = hash_number(F.col(key), seed)
    rows = df.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s"), h.alias("_h"), F.shiftright(h, 24).cast("int").alias("_b"))
    n = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(n.withColumn("_before", before).drop("_n"), ["_s", "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)) - 1)
    return df.join(ranked.select(key, F.pmod("_r", F.lit(k)).cast("int").alias(out)), key)


def beta_priors(spark, theta: float, scale: float, draws: int = 50_000, a: float = 2.0, b: float = 8.0, threshold: float = 0.05, seed: int = 42) -> DataFrame:
    """One row (p_exceeds, q025, q250, q500, q750, q975): the estimate moved towards zero by the bias of a confounder whose strengths on both sides are drawn from Beta(a, b)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for part in pdf["id"]:
                rng, n = np.random.default_rng([seed, int(part)]), draws // 16 + (int(part) < draws % 16)
                y, d = rng.beta(a, b, n), rng.beta(a, b, n)
                yield pd.DataFrame({"t": theta - np.where(theta >= 0, 1.0, -1.0) * scale * y * d / np.sqrt(np.maximum(1 - d**2, 1e-12))})

    rows = spark.range(16, numPartitions=16).mapInPandas(run, "t double")
    cuts = [0.025, 0.25, 0.5, 0.75, 0.975]
    s = rows.agg(F.avg((F.abs("t") > threshold).cast("double")).alias("p_exceeds"), F.percentile("t", F.array(*[F.lit(q) for q in cuts])).alias("q"))
    return s.select("p_exceeds", *[F.col("q")[i].alias(f"q{int(c * 1000):03}") for i, c in enumerate(cuts)])


def two_sample_distance(df: DataFrame, part: str, a: str, b: str, columns: list[str]) -> DataFrame:
    """(measure, n_a, n_b, median_a, median_b, ks): medians of two parts, and the largest gap between their distribution functions.

    Rows are counted by value first; the running sums go over the distinct values of a measure.
    """
    long = df.where(F.col(part).isin(a, b)).select(F.col(part).alias("_p"), F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("_p", "r.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = long.groupBy("measure").agg(F.count_if(F.col("_p") == a).alias("n_a"), F.count_if(F.col("_p") == b).alias("n_b"), F.median(F.when(F.col("_p") == a, F.col("v"))).alias("median_a"), F.median(F.when(F.col("_p") == b, F.col("v"))).alias("median_b"))
    steps = long.groupBy("measure", "v").agg(F.count_if(F.col("_p") == a).alias("ka"), F.count_if(F.col("_p") == b).alias("kb"))
    run = Window.partitionBy("measure").orderBy("v")
    gaps = steps.withColumns({"ca": F.sum("ka").over(run), "cb": F.sum("kb").over(run)}).join(n, "measure")
    ks = gaps.groupBy("measure").agg(F.max(F.abs(F.try_divide("ca", "n_a") - F.try_divide("cb", "n_b"))).alias("ks"))
    return n.join(ks, "measure").select("measure", "n_a", "n_b", "median_a", "median_b", "ks")
