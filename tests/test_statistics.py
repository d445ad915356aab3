"""Closed forms, estimators and learners against published values, identities and known truths."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotweave.functions import numeric as nm
from lotweave.functions import text as tx
from lotweave.operators import audit as au
from lotweave.operators import estimate as es
from lotweave.operators import identification as idn
from lotweave.operators.learners import Boosted, cross_fit, effect, logistic, probability
from lotweave.operators.spatial import nearest


def test_golden_values():
    assert nm.robustness_value(0.004845, 0.69028) == pytest.approx(0.08363, abs=2e-5)
    assert nm.chi2_sf(17.0857, 3) == pytest.approx(0.00068, abs=5e-6)
    assert nm.chi2_sf(0.8605, 3) == pytest.approx(0.835, abs=5e-4)
    assert nm.detectable(0.020959) == pytest.approx(0.0586852)
    assert nm.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert nm.e_value_interval(0.01, 0.1, 1.0) == 1.0
    assert nm.severity(0.5, 6, True) == "severe" and nm.severity(0.05, 9, True) == "low"


def test_robustness_solves_its_equation():
    for theta, scale in ((0.1, 0.5), (2.0, 1.0), (1e-4, 3.0)):
        rv = nm.robustness_value(theta, scale)
        assert scale * rv**2 / math.sqrt(1 - rv**2) == pytest.approx(theta, rel=1e-6)
    assert nm.robustness_value(0, 1) == 0 and math.isnan(nm.robustness_value(1, 0))


def test_linear_effect_recovers_truth(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(4000, 2))
    t = w @ [1.0, -0.5] + rng.normal(size=4000)
    y = 0.3 * t + w @ [0.7, 2.0] + rng.normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "t": t, "y": y, "a": w[:, 0], "b": w[:, 1]}))
    r = es.partial_linear(es.linear_residuals(df, "id", "y", "t", ["a", "b"])).first()
    assert r["ci_low"] < 0.3 < r["ci_high"] and r["se"] < 0.03
    got = es.least_squares(df, ["t", "a", "b"], "y")
    x = np.column_stack([np.ones(4000), t, w])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert [c[0] for c in got["coefficients"].values()] == pytest.approx(list(beta), abs=1e-8)
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    meat = (x * (((y - x @ beta) / (1 - h)) ** 2)[:, None]).T @ x
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x) @ meat @ np.linalg.inv(x.T @ x)))
    assert [c[1] for c in got["coefficients"].values()] == pytest.approx(list(se), rel=1e-6)


def test_treatment_without_residual(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "y_res double, t_res double")
    assert es.partial_linear(df).first()["theta"] is None


def test_scores_have_mean_zero(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"y_res": rng.normal(size=500), "t_res": rng.normal(size=500)}))
    assert abs(es.scores(df).agg(F.avg("psi")).first()[0]) < 1e-12


def test_permutations_keep_the_values(spark, scratch):
    df = spark.createDataFrame([(i, float(i * i), "ab"[i % 2]) for i in range(200)], "id long, v double, s string")
    for out in (es.permute(df, "id", "v", 4, scratch), es.permute_within(df, "id", "v", "s", 4)):
        rows = out.toPandas()
        assert sorted(rows.permuted) == sorted(rows.v) and (rows.permuted != rows.v).any()
    within = es.permute_within(df, "id", "v", "s", 4).toPandas()
    assert all(sorted(g.v) == sorted(g.permuted) for _, g in within.groupby("s"))


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(400)], "id long, v double")
    r = es.bootstrap_mean(df, "id", "v", 60).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.5


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=600)
    p = cross_fit(x, y, make=lambda: Boosted(100, 4, 0.1))
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.6
    assert np.allclose(Boosted(5, 2).fit(np.zeros((20, 2)), np.arange(20.0)).predict(np.zeros((3, 2))), 9.5)


def test_effect_and_logistic():
    rng = np.random.default_rng(2)
    t = rng.normal(size=5000)
    theta, se, psi = effect(0.5 * t + rng.normal(size=5000), t)
    assert abs(theta - 0.5) < 4 * se and abs(psi.mean()) < 1e-12
    assert math.isnan(effect(t, np.zeros(5000))[0])
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    w = logistic(x, y, 1e6)
    assert w == pytest.approx([0.5, 1.0, -2.0], abs=0.25) and probability(w, x).shape == (3000,)


def test_simulation_and_ladder(spark):
    got = es.replicate_summary(au.monte_carlo(spark, [300], [0.0], 3), ["estimator"], "truth").collect()
    assert {r["estimator"] for r in got} == {"linear", "boosted"} and all(r["n_ok"] == 3 for r in got)
    ladder = {r["rung"]: r["nats"] for r in au.capacity_ladder(spark, 1000, 1).collect()}
    assert ladder[0] < 0.05 and ladder[3] > 0.5


def test_failed_replicates_keep_their_cell(spark):
    df = spark.createDataFrame([("a", None, 1.0, 0.0, 1.0, 0.0), ("b", 1.0, 0.5, 0.0, 2.0, 0.0), ("b", float("nan"), 0.5, 0.0, 2.0, 0.0)], "c string, theta double, se double, ci_low double, ci_high double, truth double")
    got = {r["c"]: r for r in es.replicate_summary(df, ["c"], "truth").collect()}
    assert got["a"]["n_ok"] == 0 and got["a"]["bias"] is None and got["b"]["n_ok"] == 1 and got["b"]["power"] == 1.0


def test_graph():
    assert len(idn.paths(idn.GRAPH, "T", "Y")) == 9
    assert idn.separated(idn.GRAPH, "T", "Y", {"L", "X", "C"}) and not idn.separated(idn.GRAPH, "T", "Y", {"X", "C"})
    assert idn.minimal_sets(idn.GRAPH, "T", "Y") == [{"C", "L", "X"}]
    assert not idn.separated([("a", "m"), ("b", "m"), ("m", "d")], "a", "b", {"d"}) and idn.separated([("a", "m"), ("b", "m")], "a", "b", set())


def test_nearest_against_all_pairs(spark, scratch):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"id": np.arange(40), "latitude": 42 + rng.normal(0, 0.5, 40), "longitude": -71 + rng.normal(0, 0.5, 40)})
    a.loc[39, ["latitude", "longitude"]] = [-42.0, 109.0]
    got = nearest(spark.createDataFrame(a), spark.createDataFrame(a.rename(columns={"id": "o"})), "id", "o", scratch, k=3, skip_self=True).toPandas()
    la, lo = np.radians(a.latitude.to_numpy()), np.radians(a.longitude.to_numpy())
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    np.fill_diagonal(h, 9)
    want = {(i, int(j)) for i in range(40) for j in np.argsort(h[i], kind="stable")[:3]}
    assert {(r.id, r.o) for r in got.itertuples()} == want and len(got) == 120


def test_text_functions(spark):
    rows = [("It WON'T last: <b>open house</b>  at 12 Oak St, Boston MA 02115!",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(tx.clean_description(F.col("t"))).collect()]
    assert got[0] == "it will not last: at [ADDRESS]!" or got[0].startswith("it will not last:") and got[1:] == ["", ""]
    s = df.select(tx.slots(F.lit("Two-car garage, 3 BR, 2.5 baths, 1,400 sq. ft., circa 1920, three-story")).alias("s")).first()["s"]
    assert (s["beds"], s["baths"], s["sqft"], s["year_built"], s["parking"], s["stories"], s["lot_sqft"]) == (3, 2.5, 1400, 1920, 2, 3, None)
    j = spark.createDataFrame([('```json\n{"a": {"b": 1}} \n```',), ("none",)], "t string").select(tx.json_inside(F.col("t"))).collect()
    assert [x[0] for x in j] == ['{"a": {"b": 1}}', None]
    f = spark.createDataFrame([(["NN", "VB"],), ([],)], "t array<string>").select(tx.formality(F.col("t"))).collect()
    assert [x[0] for x in f] == [50.0, None]
