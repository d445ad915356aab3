"""Studies, simulations and theory: known answers, properties and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotweave.functions import numeric as nm
from lotweave.functions import text as tx
from lotweave.operators import audit as au
from lotweave.operators import counterfactual as cf
from lotweave.operators import estimate as es
from lotweave.operators import features as ft
from lotweave.operators import simulate as si
from lotweave.operators import tabular as tb
from lotweave.operators import theory as th

ROW = "city string, id long, emb array<double>, y double, w array<double>, label string, lat double, lon double"


@pytest.fixture(scope="module")
def study(spark):
    """Two cities where the place moves both text and price, and text does nothing."""
    rng, rows = np.random.default_rng(3), []
    for k, city in enumerate(("a", "b")):
        for i in range(160):
            z = int(rng.integers(0, 5))
            place = rng.normal(size=2) * 0.1 + [z, k]
            emb = np.concatenate([[z + 0.3 * rng.normal()], 0.3 * rng.normal(size=5)])
            rows.append((city, 1000 * k + i, emb.tolist(), float(0.5 * z + 0.1 * rng.normal()), [*place.tolist(), float(rng.normal())], f"z{z}", float(place[0]), float(place[1])))
    return spark.createDataFrame(rows, ROW)


def test_report(study):
    got = {r["city"]: r for r in au.report(study, 20, 2, 50, 5).collect()}
    assert set(got) == {"a", "b"} and got["a"]["n"] == 160 and got["a"]["embedding_dim"] == 6
    assert got["a"]["label_accuracy"] > 2 * got["a"]["random_baseline"] and got["a"]["spatial_rho"] > 0.3
    assert {r["severity"] for r in got.values()} <= {"severe", "high", "moderate", "low"}


def test_independence_given_the_place(study):
    got = {(r["city"], r["level"]): r for r in au.independence(study, permutations=99).collect()}
    assert len(got) == 4 and all(0 < r["p"] <= 1 for r in got.values())
    assert got["a", "label"]["mean_rho"] < 0.3
    dependent = study.withColumn("y", F.col("emb")[1] + F.col("emb")[2] + F.col("emb")[3])
    assert all(r["p"] < 0.05 for r in au.independence(dependent, permutations=99).collect())


def test_verdicts():
    assert nm.portability(0.8, -1) == "rejects_direct" and nm.portability(0.8, 0.1) == "weak_direct" and nm.portability(0.8, 0.7) == "supports_direct"
    assert nm.stability(0.0, 1.0) == "near_zero" and nm.stability(1.0, 0.1) == "rejects_direct" and nm.stability(1.0, 0.7) == "ambiguous" and nm.stability(1.0, -0.95) == "supports_direct"
    assert nm.verdict("rejects_direct", "near_zero") == "no_direct_effect" and nm.verdict("supports_direct", "supports_direct") == "direct_effect" and nm.verdict("weak_direct", "near_zero") == "ambiguous"
    assert nm.regression_robustness(0.0, 1.0) == 0 and abs(nm.regression_robustness(2.0, 1.0) - 0.5) < 1e-12


def test_model_verdicts_and_sensitivity(study):
    got = au.model_verdicts(study, 3).collect()
    assert {r["city"] for r in got} == {"a", "b"} and all(r["verdict"] in ("no_direct_effect", "direct_effect", "ambiguous") for r in got)
    for r in au.regression_sensitivity(study).collect():
        assert r["r2_full"] >= r["r2_rest"] - 1e-9 and 0 <= r["robustness"] < 1 and abs(r["t"] - r["tau"] / r["se"]) < 1e-9


def test_price_models_and_embeddings(study):
    got = {(r["city"], r["model"]): r["mae"] for r in au.price_models(study, trees=20).collect()}
    assert len(got) == 4 and all(v > 0 for v in got.values())
    both = study.withColumnRenamed("emb", "given").withColumn("reversed", F.reverse("given"))
    assert au.embedding_effects(both, ["given", "reversed"]).count() == 4


def test_stratified_folds(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"s{i % 3}") for i in range(200)], "id long, s string")
    got = es.stratified_folds(df, "id", "s", 4).groupBy(F.coalesce("s", F.lit("")).alias("s")).pivot("fold", [0, 1, 2, 3]).count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in got) and sum(sum(r[1:]) for r in got) == 200
    assert es.stratified_folds(df.limit(0), "id", "s").count() == 0


def test_bootstraps_agree(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(400)], "id long, v double")
    a, b = es.index_bootstrap(df, "id", "v", 400).first(), es.bootstrap_mean(df, "id", "v", 400).first()
    assert a["mean"] == b["mean"] == 4.5 and abs(a["low"] - b["low"]) < 0.1 and abs(a["high"] - b["high"]) < 0.1
    with pytest.raises(ValueError):
        es.index_bootstrap(df, "id", "v", 10, most=100)
    assert es.index_bootstrap(df.limit(0), "id", "v", 5).first()["mean"] is None


def test_priors_move_towards_zero(spark):
    a, b = es.beta_priors(spark, 0.5, 0.4, 8000).first(), es.beta_priors(spark, -0.5, 0.4, 8000).first()
    assert 0 < a["q500"] < 0.5 and abs(a["q500"] + b["q500"]) < 0.01 and a["q025"] < a["q250"] < a["q750"] < a["q975"]
    assert es.beta_priors(spark, 0.5, 0.0, 1000).first()["q500"] == 0.5


def test_two_sample_distance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", None), ("c", 9.0), (None, 1.0)], "p string, v double")
    r = es.two_sample_distance(df, "p", "a", "b", ["v"]).first()
    assert (r["n_a"], r["n_b"], r["ks"], r["median_a"]) == (2, 1, 1.0, 1.5)


def test_market_and_calibration(spark):
    rng = np.random.default_rng(0)
    rows = [(f"z{z}", (rng.normal(size=4) * [2, 1, 0.5, 0.2] + z).tolist()) for z in range(4) for _ in range(60)] + [("rare", [9.0, 9.0, 9.0, 9.0])]
    bins = si.bin_summaries(spark.createDataFrame(rows, "z string, e array<double>"), "z", "e", rank=2)
    got = {r["label"]: r for r in bins.collect()}
    assert not got["rare"]["own"] and got["z1"]["own"] and abs(got["z1"]["mean"][0] - np.mean([e[0] for z, e in rows if z == "z1"])) < 1e-9 and len(got["z1"]["loadings"]) == 8
    gen = si.generator_of(bins)
    slope = si.calibrated_slope(gen, 0.1)
    e, _, w, y = si.market(gen, 40_000, slope, np.random.default_rng(5))
    text = slope * (e @ gen.direction)
    base = si.market(gen, 40_000, 0.0, np.random.default_rng(6))[3]
    assert abs(text.var() / (text.var() + base.var()) - 0.1) < 0.02 and w.shape == (40_000, 5)
    out = si.replicates(spark, gen, (200,), (0.0,), 2).collect()
    assert len(out) == 8 and {r["estimator"] for r in out} == set(si.ESTIMATORS) and all(r["error"] is None for r in out)
    with pytest.raises(ValueError):
        si.generator_of(bins, 2)


def test_theory(spark):
    chain = {r["probe"]: r for r in th.bound_chain(th.probe_bounds(spark, 600, 2)).collect()}
    assert chain["linear"]["nats"] < 0.02 and chain["hidden_8"]["nats"] > 0.6 and all(r["within"] for r in chain.values())
    assert all(r["gap"] < 1e-6 for r in th.identity_gap(spark, 500, 2).collect())
    rate = th.rate_of(th.consistency(spark, (100, 1000, 5000), 12)).first()
    assert rate["sizes"] == 3 and -0.8 < rate["slope"] < -0.2
    adjusted = th.adjusted_effect(spark).first()
    assert not adjusted["directed"] and adjusted["adjustment"] == "C,L,X" and adjusted["near_zero"]
    saddle = {(r["encoder"], r["alpha"]): r for r in th.saddle_summary(th.saddle_sweep(spark, (2.0,), 1, 300, 150)).collect()}
    assert saddle["collapsed", 0.0]["hidden_nats"] < 0.01 and saddle["identity", 0.0]["hidden_nats"] > 0.6 and saddle["identity", 0.0]["linear_nats"] < 0.05
    assert th.reversed_game(spark, 1, 400, 40).count() == 1
    gate = {r["check"]: r["passed"] for r in th.ladder_gate(spark, 800, 2).collect()}
    assert gate["linear_near_zero"] and gate["gap"]


def test_features(spark, folder, scratch):
    t = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    context = ft.parcel_context(t("parcels"), t("crime"), t("amenities"), t("block_groups"), scratch)
    a = ft.features_and_target(t("listing_embeddings"), context, scratch)
    rows = ft.study_rows(a)
    assert "crime_total" in a.names and rows.where(F.size("w") != len(a.names)).count() == 0 and rows.where(F.exists("w", lambda x: x.isNull() | F.isnan(x))).count() == 0
    never = context.withColumn("crime_temporal_match", F.lit(False))
    b = ft.features_and_target(t("listing_embeddings"), never, scratch, drop_mismatched_crime=True)
    assert not b.crime_temporal_ok and b.crime_dropped and not [n for n in b.names if n.startswith("crime_")]
    bare = t("listing_embeddings").withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    c = ft.features_and_target(bare, None, scratch, bins=4)
    assert c.names == ["zip_0", "zip_1", "zip_2", "zip_3"]
    few = t("listing_embeddings").limit(10)
    assert ft.audit_rows(few).count() == 0
    assert ft.load_analysis(spark, "/tmp/absent", "sf") is None


def test_rewrites_scored(spark):
    rows = [(i, f"word{i % 7} house with view {i}", float(i % 7) + 0.01 * i, float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string, y double, x double").withColumn("v", cf.text_vector(F.col("t"), 16))
    fit = cf.text_direction(df, "v", "y", ["x"], "id")
    out = cf.scored(df, "v", ["x"], fit)
    assert out.where("predicted is null or baseline is null").count() == 0 and abs(fit["theta"]) > 0
    assert cf.text_vector(F.lit("")) is not None and df.limit(1).select(cf.text_vector(F.lit(""), 4).alias("v")).first()["v"] == [0.0] * 4
    effects = cf.arm_effects(df.select(F.lit("a").alias("arm"), "id", (F.col("y") * 0 + 0.1).alias("c")), "arm", "id", "c", 20).first()
    assert abs(effects["mean_change"] - 0.1) < 1e-9 and abs(effects["low"] - 0.1) < 1e-9 and abs(effects["percent"] - 10.517) < 0.01


def test_label_classifier(spark, scratch):
    rows = [(i, f"{'red apple tree' if i % 2 else 'blue ocean wave'} number {i}", "a" if i % 2 else "b") for i in range(60)] + [(99, None, "a"), (98, "x", None)]
    df = scratch.cut(spark.createDataFrame(rows, "id long, t string, l string"))
    told = cf.label_classifier(df, "t", "l", 256).transform(df.where("id < 60"))
    assert told.where("told = l").count() >= 58


def test_aligned_and_helpers(spark):
    known = spark.createDataFrame([(1, " A st", "01", 1.0), (2, "a ST ", "1", 3.0), (3, None, "1", 8.0)], "o long, address string, zip string, v double")
    texts = spark.createDataFrame([("A ST", "1", "t"), ("B", "x", "u")], "address string, zip string, t string")
    got = {r["t"]: (r["v"], r["matched"]) for r in cf.aligned(texts, known, ["v"], F.col("o")).collect()}
    assert got == {"t": (3.0, True), "u": (4.0, False)}
    assert texts.select(tx.built_address(F.lit("012.0"), F.lit(" Oak St ")).alias("a"), tx.built_address(F.lit("x"), F.lit("Oak")).alias("b")).first()[:] == ("12 Oak St", None)
    flagged = spark.createDataFrame([(1, 2.0, False), (2, 3.0, None)], "id long, crime_a double, ok boolean")
    assert tb.without_columns_unmatched(flagged, "ok", "crime_").columns == ["id", "ok"] and tb.without_columns_unmatched(flagged.limit(0), "ok", "crime_").columns == ["id", "crime_a", "ok"]
    assert tx.function_words() == sorted(tx.function_words()) and len(tx.function_words()) <= 200
