"""Points near other points, and regions that contain points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions.geo import SphereGrid, great_circle_m, inside, ring_edges, rings_centroid, wkt_polygons

#: Regions are cut into cells of 2**-level degrees, at a level at which a region's box spans at most about 4 x 4 of them.
FINEST, COARSEST = 12, -6


def _there(lat: str, lon: str) -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def near(points: DataFrame, targets: DataFrame, metres: float, lat: str = "latitude", lon: str = "longitude", sphere: float | None = None, kind: str | None = None) -> DataFrame:
    """Pairs of a point and a target at most ``metres`` apart along a sphere, and of the same ``kind`` if a column is named: (p: the point's row, t: the target's row, metres).

    Targets, best the smaller side, are listed in the few cells around them; points stay in their one cell and are not
    multiplied. The cells' equi-join is followed by the exact distance. A row without both coordinates is in no pair;
    repeated rows each have theirs. A crowded cell is one of many points and few targets, or the reverse, which
    adaptive execution splits; the pairs in it are the result itself.
    """
    grid = SphereGrid(metres) if sphere is None else SphereGrid(metres, sphere)
    a = points.where(_there(lat, lon)).select(F.struct(*points.columns).alias("p")).withColumn("cell", grid.cell(F.col(f"p.{lat}"), F.col(f"p.{lon}")))
    b = targets.where(_there(lat, lon)).select(F.struct(*targets.columns).alias("t")).withColumn("cell", F.explode(grid.around(F.col(f"t.{lat}"), F.col(f"t.{lon}"))))
    args = () if sphere is None else (sphere,)
    keys = ["cell"]
    if kind:
        a, b, keys = a.withColumn("_kind", F.col(f"p.{kind}")), b.withColumn("_kind", F.col(f"t.{kind}")), ["cell", "_kind"]
    pairs = a.join(b, keys).withColumn("metres", great_circle_m(F.col(f"p.{lat}"), F.col(f"p.{lon}"), F.col(f"t.{lat}"), F.col(f"t.{lon}"), *args))
    return pairs.where(F.col("metres") <= metres).select("p", "t", "metres")


def locate(df: DataFrame, lat: str = "latitude", lon: str = "longitude", geometry: str = "geometry") -> DataFrame:
    """df with ``_x`` and ``_y``: its longitude and latitude if both are there, else the centroid of its geometry, else null."""
    both = _there(lat, lon)
    centre = rings_centroid(wkt_polygons(F.when(~both, F.col(geometry))))
    out = df.withColumn("_c", F.when(both, F.struct(F.col(lon).alias("x"), F.col(lat).alias("y"))).otherwise(centre))
    return out.withColumns({"_x": F.col("_c.x"), "_y": F.col("_c.y")}).drop("_c")


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, level: Column) -> Column:
    size = F.pow(F.lit(2.0), -level)
    xs, ys = F.sequence(F.floor(x0 / size), F.floor(x1 / size)), F.sequence(F.floor(y0 / size), F.floor(y1 / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(level.cast("int").alias("level"), x.cast("long").alias("x"), y.cast("long").alias("y")))))


def containing(points: DataFrame, regions: DataFrame, region: str = "geometry", x: str = "_x", y: str = "_y") -> DataFrame:
    """Pairs of a point and a region (WKT polygon or multipolygon, holes left out) that contains it: (p, t).

    A region is hashed to the cells its box covers, at a level that suits its size, with the edges a ray
    within that cell's rows can meet; a point is hashed at each level in use (at most 19). The equi-join is followed by the
    even-odd test. Points without a location and regions without a readable polygon are in no pair.
    """
    shapes = regions.select(F.struct(*[c for c in regions.columns if c != region]).alias("t"), wkt_polygons(F.col(region)).alias("rings"))
    shapes = shapes.where("rings is not null").withColumn("edges", ring_edges(F.col("rings"))).where("size(edges) > 0")
    xs, ys = F.transform("edges", lambda e: e["x0"]), F.transform("edges", lambda e: e["y0"])
    xe, ye = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    shapes = shapes.withColumns({"x0": F.array_min(F.concat(xs, xe)), "x1": F.array_max(F.concat(xs, xe)), "y0": F.array_min(F.concat(ys, ye)), "y1": F.array_max(F.concat(ys, ye))})
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    level = F.least(F.greatest(F.floor(-F.log2(span / 3)), F.lit(COARSEST)), F.lit(FINEST))
    shapes = shapes.withColumn("level", level).withColumn("cell", F.explode(_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("level"))))
    size = F.pow(F.lit(2.0), -F.col("level"))
    low, high, left = F.col("cell.y") * size, (F.col("cell.y") + 1) * size, F.col("cell.x") * size
    shapes = shapes.withColumn("edges", F.filter("edges", lambda e: (F.least(e["y0"], e["y1"]) <= high) & (F.greatest(e["y0"], e["y1"]) >= low) & (F.greatest(e["x0"], e["x1"]) >= left)))
    shapes = shapes.select("t", "cell", "edges")

    levels = sorted(r[0] for r in shapes.select("cell.level").distinct().collect())  # at most 19 numbers
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.struct(*[c for c in points.columns if c not in (x, y)]).alias("p"), F.col(x).alias("x"), F.col(y).alias("y"))
    if not levels:
        return placed.join(shapes.select("t"), F.lit(False)).select("p", "t")
    at = [F.struct(F.lit(k).alias("level"), F.floor(F.col("x") * 2.0**k).cast("long").alias("x"), F.floor(F.col("y") * 2.0**k).cast("long").alias("y")) for k in levels]
    placed = placed.withColumn("cell", F.explode(F.array(*at)) if len(at) > 1 else at[0])
    return placed.join(shapes, "cell").where(inside(F.col("edges"), F.col("x"), F.col("y"))).select("p", "t")
