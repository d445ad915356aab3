"""Registered queries do the whole job: on inputs made larger or odder than the given tables."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotweave.functions import text as tx
from lotweave.operators import audit as au
from lotweave.operators import counterfactual as cf
from lotweave.operators import draws as dr
from lotweave.operators import estimate as es
from lotweave.operators import learners as le
from lotweave.plans import reference


def study_tables(spark, path, n, zips=("00443", "00467"), seed=0):
    """A folder with listing_embeddings (one city, n rows) and parcels; its rows as pandas."""
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"emb_id": np.arange(n), "city": "x", "price": np.exp(rng.normal(13, 1, n)), "latitude": 42 + rng.normal(0, 0.1, n), "longitude": -71 + rng.normal(0, 0.1, n)})
    rows["emb"], rows["zip"], rows["parcel_id"] = list(rng.normal(size=(n, 4))), [zips[i % len(zips)] for i in range(n)], [f"p{i}" for i in range(n)]
    spark.createDataFrame(rows.assign(emb=[e.tolist() for e in rows["emb"]])).write.parquet(f"{path}/listing_embeddings.parquet")
    spark.createDataFrame([("p1", 1950.0, 1.0, 2.0, 3.0)], "parcel_id string, year_built double, bldg_area_sqft double, lot_area_sqft double, bedrooms double").write.parquet(f"{path}/parcels.parquet")
    return rows


@pytest.mark.parametrize("name", ["doubly_robust_boosted", "confounder_escalation"])
def test_a_large_city_is_one_study(spark, tmp_path, name):
    study_tables(spark, tmp_path, 2300)
    got = reference.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert set(got.city) == {"x"} and len(got) == (1 if name == "doubly_robust_boosted" else 7)
    assert "n" not in got or list(got.n) == [2300]


def test_rank_correlation_takes_all_pairs(spark, tmp_path):
    rows = study_tables(spark, tmp_path, 900)
    got = reference.QUERIES["spatial_rank_correlation"](spark, str(tmp_path)).first()
    t, g = np.vstack(rows["emb"]), rows[["latitude", "longitude"]].to_numpy()
    u, (i, j) = t / np.linalg.norm(t, axis=1, keepdims=True), np.triu_indices(900, 1)
    a, b = np.linalg.norm(g[i] - g[j], axis=1), 1 - (u @ u.T)[i, j]
    assert got["pairs"] == 900 * 899 // 2
    assert got["rho"] == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank()), abs=1e-9)


def test_rank_correlation_counts_ties(spark):
    rows = [(i, "x", [float(i % 3), 1.0], float(i % 4), 0.0) for i in range(40)] + [(99, "y", [1.0], 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, city string, emb array<double>, lat double, lon double")
    got = {r["city"]: r for r in au.spatial_rank_correlation(df).collect()}
    d = pd.DataFrame(rows[:40], columns=["id", "city", "emb", "lat", "lon"])
    parts = list(au.pair_distances(np.vstack(d["emb"]), d[["lat", "lon"]].to_numpy()))
    a, b = (pd.Series(np.concatenate([p[k] for p in parts])) for k in range(2))
    assert got["x"]["rho"] == pytest.approx(a.rank().corr(b.rank()), abs=1e-9) and got["x"]["pairs"] == 780
    assert got["y"]["pairs"] == 0 and got["y"]["rho"] is None


def test_zips_that_lost_zeros_are_labels(spark, tmp_path):
    study_tables(spark, tmp_path, 60, zips=("443", "00443-1234", "467.0"))
    got = reference.QUERIES["label_accuracy"](spark, str(tmp_path)).first()
    assert got["classes"] == 2 and got["majority"] == pytest.approx(2 / 3)


def test_many_labels_have_an_accuracy(spark, tmp_path):
    study_tables(spark, tmp_path, 5 * 510, zips=[f"{10000 + i}" for i in range(510)])
    got = reference.QUERIES["label_accuracy"](spark, str(tmp_path)).first()
    assert got["classes"] == 510 and got["baseline"] == pytest.approx(1 / 510) and got["accuracy"] is not None and got["majority"] == pytest.approx(1 / 510)


def test_rewrites_are_judged_where_they_are(spark):
    """Each text by itself, also two of one key, without a shuffle of texts; perplexity as counted by hand."""
    texts = {1: ["Two beds, built in 1920, at 12 Park St.", "zq"], 2: ["A İstanbul loft with 3 baths"], 3: ["x"]}
    df = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts] + [(4, None), (5, " ")], "k long, t string")
    noise = lambda arm, t: F.when(arm == "style_swap", F.lit("4 beds ~^`|#")).when(arm == "identity", t).otherwise(F.lower(t))
    out = cf.rewrites(df, "k", "t", F.lit("here"), noise)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["k"], r["prompt"].count("zq"), r["arm"]): (r["facts_kept"], r["fluent"], r["passed"]) for r in out.collect()}
    assert len(got) == 16
    assert got[1, 0, "identity"] == got[1, 1, "identity"] == got[2, 0, "place_removed"] == (True, True, True)
    assert got[1, 0, "style_swap"][0] is False and got[1, 1, "style_swap"][0] is True and got[3, 0, "identity"] == (True, False, False)
    pairs = Counter(t.lower()[i : i + 2] for ts in texts.values() for t in ts for i in range(len(t) - 1))
    first, kinds = Counter(), Counter()
    for p, n in pairs.items():
        first[p[0]] += n
        kinds[p[0]] += 1
    logp = {p: np.log((n + 1) / (first[p[0]] + kinds[p[0]] + 1)) for p, n in pairs.items()}
    model = cf.letter_model(df, "t")
    assert {r["gram"]: pytest.approx(r["logp"]) for r in model.collect()} == logp
    asked = ["A İstanbul loft", "zq~", "b", None, "Ünseen 日本"]
    told = [r["p"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string").withColumn("p", cf.perplexity(model)(F.col("t"))).orderBy("i").collect()]
    for t, p in zip(asked, told):
        want = None if t is None or len(t) < 2 else np.exp(-np.mean([logp.get(t.lower()[i : i + 2], min(logp.values())) for i in range(len(t) - 1)]))
        assert p == (None if want is None else pytest.approx(want))


def test_letter_pairs_of_large_alphabets(spark):
    df = spark.createDataFrame([(1, "two plain texts"), (2, "of letters")], "k long, t string")
    table = [cf.letter_model(df, "t").orderBy("gram").collect(), df.select(cf.perplexity(cf.letter_model(df, "t"))(F.col("t"))).collect()]
    wide = spark.createDataFrame([(3, "".join(chr(0x4E00 + i) for i in range(2100)))], "k long, t string")
    both = cf.letter_model(df.union(wide), "t")
    assert both.where("gram < 'zz'").orderBy("gram").collect() == table[0] and both.count() == len(table[0]) + 2099
    assert df.select(cf.perplexity(both)(F.col("t")).alias("p")).collect() == table[1]


def test_place_words_are_removed_as_one_after_another(spark):
    rng, words = np.random.default_rng(1), [w.replace(r"\d{5}", "02115") for w in tx.PLACE_WORDS] + ["valley", "upper", "east", "é"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "-", ".", "", "́"]) for _ in range(12)) for _ in range(400)]
    one = F.lower("t")
    for p in tx.PLACE_WORDS:
        one = F.regexp_replace(one, rf"\b{p}\b", "")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(tx.squeeze(one) != tx.without_places(F.col("t"))).count() == 0


def test_label_accuracy_of_a_large_city(spark, tmp_path):
    """A city of more rows than a task takes has its accuracy too, the same as from one array with the same folds."""
    rng, names = np.random.default_rng(2), ["b", "a", "c"]
    rows = [("x", i, (rng.normal(size=6) + np.eye(6)[i % 3] * 2).tolist(), names[i % 3]) for i in range(300)] + [("x", 300, [0.0] * 6, "rare"), ("x", 301, [9.0] * 6, None)]
    rows += [("y", i, rng.normal(size=6).tolist(), names[i % 2]) for i in range(40)] + [(None, i, rng.normal(size=6).tolist(), "a") for i in range(120)]
    df = spark.createDataFrame(rows, "city string, id long, emb array<double>, label string").repartition(3)
    got = {r["city"]: r for r in au.label_accuracy(df, most=100).collect()}
    one = {r["city"]: r for r in au.label_accuracy(df).collect()}
    assert got["y"] == one["y"] and got[None] == one[None]
    at = {r["id"]: r["f"] for r in df.where("city = 'x'").select("id", es.fold(F.col("id")).alias("f")).collect()}
    t, y, at = np.array([r[2] for r in rows[:300]]), np.array([names.index(r[3]) for r in rows[:300]]), np.array([at[i] for i in range(300)])
    y = np.array([1, 0, 2])[y]  # in the order of names
    x, hits = le.standardise(le.principal(t, 6)), 0
    for f in range(5):
        net, own = le.Network([6, 3], 42), at != f
        for _ in range(120):
            g = le.softmax(net.forward(x[own]))
            g[np.arange(len(g)), y[own]] -= 1
            net.backward(g / own.sum(), 0.05, 1e-3)
        hits += (net.forward(x[~own]).argmax(axis=1) == y[~own]).sum()
    assert got["x"]["accuracy"] == pytest.approx(hits / 300, abs=1e-9) and hits > 200
    assert all(got["x"][c] == pytest.approx(one["x"][c]) for c in ("classes", "baseline", "sum_of_squares", "majority"))


def test_text_vectors_are_signed_sums_of_hashed_words(spark):
    df = spark.createDataFrame([("Red house, red DOOR 12",), ("",), (None,), ("Überbau 日本 x",)], "t string")
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    for r in df.select(cf.text_vector(F.col("t"), 8, 3).alias("v"), F.transform(words, lambda w: F.xxhash64(w, F.lit(3))).alias("h")).collect():
        v = np.zeros(8)
        for h in r["h"] or []:
            v[h % 8] += -1.0 if h % 3 == 0 else 1.0
        assert r["v"] == (v / (np.linalg.norm(v) or 1)).tolist()


def test_draws_are_those_of_the_hash(spark):
    """Weights drawn in blocks are poisson_weight()'s, for keys of all lengths; and no row is repeated for each resample."""
    keys = [None, "", "7", "5000000012", "é日本", *["k" * n for n in range(40, 70)], "long" * 40]
    rows = [(k, b) for k in keys for b in (1, 9, 10, 101)]
    df = spark.createDataFrame(rows, "k string, b int").select("k", "b", es.poisson_weight(F.col("k"), F.col("b")).alias("w"))
    want = {(r["k"], r["b"]): r["w"] for r in df.collect()}
    drawn = list(dr.poisson_weights(keys, 101))
    assert all(drawn[b - 1][i] == want[k, b] for i, k in enumerate(keys) for b in (1, 9, 10, 101))
    changes = spark.createDataFrame([(i % 50, "ab"[i % 2], float(i % 7) if i % 5 else None) for i in range(200)] + [(None, "a", 1.0), (1, None, 2.0)], "k long, arm string, c double")
    out = cf.arm_effects(changes, "arm", "k", "c", 30)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    weights = changes.where("c is not null and arm is not null").crossJoin(spark.range(1, 31).toDF("b")).withColumn("w", es.poisson_weight(F.col("k"), F.col("b")))
    means = weights.groupBy("arm", "b").agg((F.sum(F.col("c") * F.col("w")) / F.sum("w")).alias("m"))
    want = {r["arm"]: r["q"] for r in means.groupBy("arm").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).collect()}
    got = {r["arm"]: [r["low"], r["high"]] for r in out.collect()}
    assert set(got) == {"a", "b"} and all(got[a] == pytest.approx(want[a]) for a in got)
