"""Counting, measuring and taking over attributes from what lies around a point."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotweave.functions.geo import EARTH_M
from lotweave.operators.proximity import near
from lotweave.session import Scratch


def project(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float, unit_m: float = 1.0) -> Column:
    """(x, y) in units of unit_m metres around an origin (local equirectangular)."""
    lat0, lon0 = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lat0, lon0))
    k = math.pi / 180 * EARTH_M / unit_m
    return F.struct(((lon - lon0) * F.cos(F.radians(lat0)) * k).alias("x"), ((lat - lat0) * k).alias("y"))


def counts_around(sites: DataFrame, points: DataFrame, site_id: str, metres: float, category: str, categories: list[str], prefix: str) -> DataFrame:
    """(site_id, <prefix><category> for each category, <prefix>total, <prefix>entropy) of the points around each site; zeros without any.

    Points at one place with one category are counted before they are paired. Entropy (natural logarithm) is over all
    categories that occur, in the form ln N - sum(n ln n) / N, so one aggregation gives all; pairs are
    aggregated before they are shuffled by site.
    """
    c = F.coalesce(F.col(category), F.lit(""))
    at = points.groupBy("latitude", "longitude", c.alias("c")).agg(F.count("*").alias("k"))
    pairs = near(sites.select(site_id, "latitude", "longitude"), at, metres).select(F.col(f"p.{site_id}").alias(site_id), F.col("t.c").alias("c"), F.col("t.k").alias("k"))
    by = pairs.groupBy(site_id, "c").agg(F.sum("k").alias("k"))
    n = F.sum("k")
    out = by.groupBy(site_id).agg(
        *[F.sum(F.when(F.col("c") == v, F.col("k")).otherwise(0)).alias(f"{prefix}{v}") for v in categories],
        n.alias(f"{prefix}total"),
        (F.ln(n) - F.sum(F.col("k") * F.ln("k")) / n).alias(f"{prefix}entropy"),
    )
    names = [f"{prefix}{v}" for v in [*categories, "total"]]
    return sites.select(site_id).join(out, site_id, "left").select(site_id, *[F.coalesce(m, F.lit(0)).alias(m) for m in names], F.coalesce(f"{prefix}entropy", F.lit(0.0)).alias(f"{prefix}entropy"))


def densities(df: DataFrame, columns: list[str], radius_km: float) -> DataFrame:
    """df with each count per square kilometre of the circle."""
    return df.withColumns({f"{c}_density": F.col(c) / (math.pi * radius_km**2) for c in columns})


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, scratch: Scratch, k: int = 1, start_m: float = 250.0, skip_self: bool = False, rounds: int = 20, kind: str | None = None) -> DataFrame:
    """(point_id, target_id, metres, rank): the k nearest targets of each point, ties by target_id; fewer if there are not so many.

    Rings of growing radius: points that have k targets within the radius are done, for nothing outside is nearer; only
    the others go on, with twice the radius, after some rounds four times, up to half the earth's girth. So the work follows the density of targets, and
    no point is held against all targets but those that far. skip_self leaves out the target with the point's id.
    With ``kind``, a column of both, only targets of a point's kind count, all kinds in the same rounds, and the kind is among the columns; points of a kind without targets are left out.
    """
    there = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude"))
    kinds = [kind] if kind else []
    slim = targets.select(target_id, "latitude", "longitude", *kinds)
    if kind:
        there = there.join(slim.where("latitude is not null and longitude is not null").select(kind).distinct(), kind, "left_semi")
    left, done, radius = scratch.cut(there.select(point_id, "latitude", "longitude", *kinds)), [], start_m
    keys = ["_p", *["_k" for _ in kinds]]
    for turn in range(rounds):
        found = near(left, slim, min(radius, math.pi * EARTH_M), kind=kind)
        found = found.select(F.col(f"p.{point_id}").alias("_p"), F.col(f"t.{target_id}").alias("_t"), "metres", *[F.col(f"p.{c}").alias("_k") for c in kinds])
        if skip_self:
            found = found.where("_p <> _t")
        if k == 1:
            best = found.groupBy(*keys).agg(F.array(F.min(F.struct("metres", "_t"))).alias("b"))
        else:  # the rank limit is applied before the shuffle too, so no crowded circle is gathered
            ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("metres", "_t"))).where(F.col("_r") <= k)
            best = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("metres", "_t"))).alias("b"))
        best = scratch.cut(best.where(F.size("b") >= k) if radius < math.pi * EARTH_M else best)
        done.append(best)
        if radius >= math.pi * EARTH_M:
            break
        left = scratch.cut(left.join(best.select(F.col("_p").alias(point_id), *[F.col("_k").alias(c) for c in kinds]), [point_id, *kinds], "left_anti"))
        if left.isEmpty():
            break
        radius *= 2 if turn < 4 else 4
    rows = reduce(DataFrame.unionAll, done)
    named = [F.col("_k").alias(c) for c in kinds]
    return rows.select(F.col("_p").alias(point_id), *named, F.posexplode("b").alias("i", "r")).select(point_id, *kinds, F.col("r._t").alias(target_id), F.col("r.metres").alias("metres"), (F.col("i") + 1).alias("rank"))


def nearest_by_category(points: DataFrame, targets: DataFrame, point_id: str, category: str, categories: list[str], scratch: Scratch, prefix: str = "dist_") -> DataFrame:
    """(point_id, <prefix><category>_m): distance to the nearest target of each category, null where there is none. The categories are searched side by side."""
    some = scratch.cut(targets.where(F.col(category).isin(*categories)).select(F.monotonically_increasing_id().alias("_tid"), F.col(category).alias("_c"), "latitude", "longitude"))
    each = points.select(point_id, "latitude", "longitude", F.explode(F.array(*[F.lit(c) for c in categories])).alias("_c"))
    hit = nearest(each, some, point_id, "_tid", scratch, kind="_c")
    wide = hit.groupBy(point_id).agg(*[F.min(F.when(F.col("_c") == c, F.col("metres"))).alias(f"{prefix}{c}_m") for c in categories])
    return points.select(point_id).join(wide, point_id, "left")


def take_over(points: DataFrame, donors: DataFrame, point_id: str, donor_id: str, columns: list[str], scratch: Scratch) -> DataFrame:
    """points' ids, their nearest donor, its distance and its columns."""
    hit = nearest(points, donors, point_id, donor_id, scratch).drop("rank")
    return hit.join(donors.select(donor_id, *columns), donor_id)


def mean_gap_by_group(points: DataFrame, point_id: str, group: str, scratch: Scratch) -> DataFrame:
    """(group, n, mean_gap_m): mean distance of a group's points to their nearest other point of the group."""
    parts = []
    for (g,) in points.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).collect():  # groups are splits: a few
        some = points.where(F.col(group) == g)
        hit = nearest(some, some.select(F.col(point_id).alias("_o"), "latitude", "longitude"), point_id, "_o", scratch, skip_self=True)
        parts.append(hit.agg(F.lit(g).alias(group), F.count("*").alias("n"), F.avg("metres").alias("mean_gap_m")))
    return reduce(DataFrame.unionAll, parts)


def grid_labels(df: DataFrame, lat: str = "latitude", lon: str = "longitude", bins: int = 20, out: str = "cell") -> DataFrame:
    """df with a label of its cell in a grid of bins x bins over the extent; bins of equal width, closed on the right, the lowest value in the first."""
    e = df.agg(F.min(lat).alias("a0"), F.max(lat).alias("a1"), F.min(lon).alias("o0"), F.max(lon).alias("o1"))

    def bin_of(c: str, lo: str, hi: str) -> Column:
        w = (F.col(hi) - F.col(lo)) / bins
        return F.least(F.greatest(F.ceil((F.col(c) - F.col(lo)) / F.when(w != 0, w)), F.lit(1)), F.lit(bins)) - 1

    return df.crossJoin(F.broadcast(e)).withColumn(out, F.concat_ws("_", bin_of(lat, "a0", "a1"), bin_of(lon, "o0", "o1"))).drop("a0", "a1", "o0", "o1")  # one row



def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def price_check(asked: DataFrame, recorded: DataFrame, asked_id: str, recorded_id: str, asked_price: str, recorded_price: str, radii: list[int]) -> DataFrame:
    """(radius, n, rho, median_ratio, sd_log): of asked prices and the price recorded nearest to each, ties by id, within each radius in metres: correlation of logarithms, median ratio, spread of the log difference."""
    hit = near(asked, recorded, float(max(radii))).select(F.col(f"p.{asked_id}").alias("_p"), F.col(f"p.{asked_price}").alias("_a"), F.struct("metres", F.col(f"t.{recorded_id}").alias("i"), F.col(f"t.{recorded_price}").alias("v")).alias("_n"))
    one = hit.groupBy("_p").agg(F.first("_a").alias("_a"), F.min("_n").alias("_n"))
    within = one.withColumn("radius", F.explode(F.filter(F.array(*[F.lit(r) for r in radii]), lambda r: F.col("_n.metres") <= r)))
    a, b = F.ln("_a"), F.ln("_n.v")
    return within.groupBy("radius").agg(F.count("*").alias("n"), F.corr(a, b).alias("rho"), F.median(F.col("_n.v") / F.col("_a")).alias("median_ratio"), F.stddev_samp(b - a).alias("sd_log"))
