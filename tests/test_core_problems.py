"""Edge cases of the core's operators for training data: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotweave.operators.components import connected_components, tie_groups
from lotweave.operators.deliveries import fold_batch, home_of, split_deliveries
from lotweave.operators.impute import Category, Numeric, fill_from_like, fill_parcels
from lotweave.operators.proximity import containing, locate, near
from lotweave.operators.ranking import global_rank


def roots_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, scratch, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(40)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [(None, "x"), ("y", "y")]
    got = connected_components(spark.createDataFrame(edges, "u string, v string"), scratch).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == roots_by_hand(edges)


def test_components_of_nothing(spark, scratch):
    assert connected_components(spark.createDataFrame([], "u string, v string"), scratch).count() == 0


def test_hot_key_ties(spark, scratch):
    rows = [(i, "hub", None) for i in range(200)] + [(200, "hub", "p"), (201, None, "p"), (202, None, None), (203, "b", "q"), (204, "a", "q")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r["id"]: r["group"] for r in tie_groups(df, "id", [F.col("a"), F.col("b")], scratch).collect()}
    assert len(got) == 205 and {got[i] for i in [*range(200), 200, 201]} == {"0:hub"}
    assert got[202] is None and got[203] == got[204] == "0:a"




def deliveries(spark, rows):
    return spark.createDataFrame(rows, "delivery_id long, t string, address string, city_name string, price double, url string, _other string").withColumn("delivered_at", F.col("t").cast("timestamp")).drop("t")


def test_deliveries(spark, scratch):
    rows = [
        (1, "2024-01-02", "1 Oak", "X", 5.0, "/MA/x/home/12", "keep"),
        (2, "2024-01-01", "1 OAK", "X", 5.0, "HTTPS://WWW.LISTINGS.EXAMPLE/MA/y/home/012/?ref=/home/99#map", None),
        (3, None, "1  oak ", "X", 5.0, None, None),
        (4, "2024-01-01", "2 Oak", "X", 5.0, " ", None),
        (5, "2024-01-01", "2 Oak", "X", 5.0, "", None),
        (6, "2024-01-01", None, "X", 5.0, None, None),
        (7, "2024-01-01", None, "X", 5.0, None, None),
        (8, "2024-01-01", "3 Oak", "X", float("nan"), None, None),
        (9, "2024-01-01", "3 Oak", "X", float("nan"), None, None),
        (10, "2024-01-01", "1 oak", "X", 5.0, "/home/77", None),
        (11, "2024-01-01", "9 Elm", "X", 1.0, "https://elsewhere.example/home/12", None),
    ]
    kept, dropped = split_deliveries(deliveries(spark, rows), scratch)
    assert sorted(r["delivery_id"] for r in dropped.collect()) == [1, 3, 5, 10]
    assert sorted(r["delivery_id"] for r in kept.collect()) == [2, 4, 6, 7, 8, 9, 11]
    assert kept.columns == deliveries(spark, rows).columns


def test_repeated_rows_keep_exactly_one(spark, scratch):
    rows = [(1, "2024-01-01", "a", "X", 5.0, "/home/1", None)] * 50
    kept, dropped = split_deliveries(deliveries(spark, rows), scratch)
    assert kept.count() == 1 and dropped.count() == 49


def test_empty_and_folded_deliveries(spark, scratch):
    some = deliveries(spark, [(1, "2024-01-05", "a", "X", 5.0, "/home/1", None)])
    kept, dropped = split_deliveries(some.limit(0), scratch)
    assert kept.count() == 0 and dropped.count() == 0
    late = deliveries(spark, [(2, "2024-01-01", "a", "X", 5.0, "/home/1", None)])
    kept, dropped = fold_batch(some, late, scratch)
    assert [r["delivery_id"] for r in kept.collect()] == [2] and [r["delivery_id"] for r in dropped.collect()] == [1]


def test_home_of(spark):
    urls = ["http://m.listings.example/a/home/3", "//listings.example/home/3/", "/home/3?x=/home/4", "https://listings.example.evil.test/home/3", "/homes/3", "home/3", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(home_of(F.col("url")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["3", "3", "3", None, None, None, None, None]


def test_fill_marks_and_clamps(spark, scratch):
    rows = [(1, "a", 2.0, "r1"), (2, "a", 4.0, " R1 "), (3, "a", None, "nan"), (4, "a", float("nan"), "R2"), (5, "b", None, None), (6, None, None, ""), (6, None, None, "")]
    df = spark.createDataFrame(rows, "row_id long, g string, x double, k string").withColumn("x_filled_old", F.lit(1))
    out = fill_from_like(df, [Numeric("x", 0, 10)], [Category("k", ("R1", "R2"))], [([F.col("g")], 1.0)], scratch)
    got = out.orderBy("row_id").collect()
    assert [r["x_filled"] for r in got] == [False, False, True, True, True, True, True]
    assert got[0]["x"] == 2.0 and abs(got[2]["x"] - 3.0) < 1e-6 and got[4]["x"] is not None
    assert [r["k"] for r in got] == ["R1", "R1", "R1", "R2", "R1", "R1", "R1"]
    assert [r["k_filled"] for r in got] == [False, False, True, False, True, True, True]


def test_fill_without_anything(spark, scratch):
    df = spark.createDataFrame([(1, None, None)], "row_id long, x double, k string")
    got = fill_from_like(df, [Numeric("x", 0, 1)], [Category("k", ("A",))], [], scratch).first()
    assert got["x"] is None and not got["x_filled"] and got["k"] is None and not got["k_filled"]
    assert fill_from_like(df.limit(0), [Numeric("x", 0, 1)], [], [], scratch).count() == 0


def test_fill_of_many_groups_is_that_of_few(spark, scratch, folder, monkeypatch):
    """Levels of many groups are shuffled, those of few broadcast; the fills are the same."""
    parcels = spark.read.parquet(f"{folder}/parcels.parquet")
    cols = ["row_id", "bedrooms", "year_built", "bldg_area_sqft", "land_use", "bedrooms_filled"]
    few = fill_parcels(parcels, scratch, 3).select(*cols).toPandas().sort_values("row_id").reset_index(drop=True)
    for most in (0, 30):
        monkeypatch.setattr("lotweave.operators.impute.FEW_GROUPS", most)
        many = fill_parcels(parcels, scratch, 3).select(*cols).toPandas().sort_values("row_id").reset_index(drop=True)
        assert few.round(2).equals(many.round(2))


def test_fill_parcels_beats_the_mean(spark, folder, scratch):
    """Held-out values come out nearer than the city's mean."""
    parcels = spark.read.parquet(f"{folder}/parcels.parquet").where("bldg_area_sqft between 100 and 1000000").withColumn("bldg_area_sqft", F.log("bldg_area_sqft") * 1000)
    held = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    out = fill_parcels(parcels.withColumn("bldg_area_sqft", F.when(~held, F.col("bldg_area_sqft"))), scratch).select("row_id", F.col("bldg_area_sqft").alias("p"), "bldg_area_sqft_filled")
    got = out.join(parcels.select("row_id", "city", F.col("bldg_area_sqft").alias("v")), "row_id").toPandas()
    mean = got[~got.bldg_area_sqft_filled].groupby("city").v.mean()
    some = got[got.bldg_area_sqft_filled]
    assert len(some) and (some.p - some.v).abs().mean() < (some.v - some.city.map(mean)).abs().mean()


def metres(a, b):
    (la, oa), (lb, ob) = [[math.radians(v) for v in p] for p in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [60.0, 5_000.0, 400_000.0])
def test_near_against_all_pairs(spark, radius):
    r = random.Random(int(radius))
    deg = radius / 111_000
    middles = [(0, 0), (42.3, -71), (89.999, 10), (-89.9999, 0), (10, 179.9999), (60, -180)]
    points = [(max(-90.0, min(90.0, la + r.uniform(-2, 2) * deg)), (lo + r.uniform(-2, 2) * deg / max(0.01, math.cos(math.radians(la))) + 180) % 360 - 180) for la, lo in middles for _ in range(25)] + [(42.3, -71.0)] * 5
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(points[::2])] + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, latitude double, longitude double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(points[1::2])], "id long, latitude double, longitude double").withColumn("cell", F.lit("clash"))
    got = {(x["p"]["id"], x["t"]["id"]) for x in near(a, b, radius).collect()}
    want = {(i, j) for i, p in enumerate(points[::2]) for j, q in enumerate(points[1::2]) if metres(p, q) <= radius}
    assert got == want and want


def test_near_empty(spark):
    none = spark.createDataFrame([], "id long, latitude double, longitude double")
    assert near(none, none, 10).count() == 0


REGIONS = [
    ("holed", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"),
    ("island", "MULTIPOLYGON (((1.5 1.5, 2.5 1.5, 2.5 2.5, 1.5 2.5, 1.5 1.5)), ((10 10, 11 10, 11 11, 10 11, 10 10)))"),
    ("huge", "polygon((-100 -80,100 -80,100 80,-100 80,-100 -80))"),
    ("empty", "POLYGON EMPTY"), ("broken", "POLYGON ((1 x, 2 2))"), ("null", None), ("line", "LINESTRING (0 0, 1 1)"),
]


def test_regions(spark):
    regions = spark.createDataFrame(REGIONS, "geoid string, geometry string")
    rows = [(1, 0.5, 0.5, None), (2, 2.0, 2.0, None), (3, 10.5, 10.5, None), (4, 2.9, 1.2, None), (5, None, 1.0, "POINT (0.5 0.5)"), (6, None, None, REGIONS[0][1]), (7, None, None, None), (8, float("nan"), 1.0, "POLYGON ((0.2 0.2, 0.8 0.2, 0.8 0.8, 0.2 0.8, 0.2 0.2))")]
    points = locate(spark.createDataFrame(rows, "row_id long, latitude double, longitude double, geometry string")).select("row_id", "_x", "_y")
    got = sorted((r["p"]["row_id"], r["t"]["geoid"]) for r in containing(points, regions).collect())
    assert [g for g in got if g[1] != "huge"] == [(1, "holed"), (2, "island"), (3, "island"), (5, "holed"), (6, "island"), (8, "holed")]
    assert [g[0] for g in got if g[1] == "huge"] == [1, 2, 3, 4, 5, 6, 8]
    assert containing(points, regions.where("geoid = 'empty'")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40))
def test_global_rank(spark, values):
    from lotweave.session import Scratch

    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    got = [(r["rank"], r["v"], r["i"]) for r in global_rank(df, [F.col("v"), F.col("i")], Scratch(spark)).collect()]
    assert sorted(got) == [(k, *x) for k, x in enumerate(sorted((v, i) for i, v in enumerate(values)))]


