"""Points, rings and grids as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Metres along a sphere between two points given in degrees (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


class SphereGrid:
    """Cells of a sphere a little larger than a search radius, in bands of latitude.

    A point lies in one cell; all points within the radius of it lie in at most three bands' cells next
    to it, which ``around`` lists. Bands near a pole have fewer cells; the date line wraps.
    """

    def __init__(self, metres: float, radius: float = EARTH_M):
        if not metres > 0:
            raise ValueError("the distance must be above 0")
        self.angle = metres / radius
        self.step = math.degrees(self.angle) * 1.0001
        self.top = int(180 // self.step)

    def band(self, lat: Column) -> Column:
        return F.least(F.greatest(F.floor((lat + 90) / self.step), F.lit(0)), F.lit(self.top)).cast("long")

    def _count(self, band: Column) -> Column:
        """Cells in a band: none narrower than the step where the band is narrowest."""
        edge = F.greatest(F.abs(band * self.step - 90), F.abs((band + 1) * self.step - 90))
        return F.greatest(F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / self.step), F.lit(1)).cast("long")

    def _column(self, band: Column, lon: Column) -> Column:
        n = self._count(band)
        return F.pmod(F.floor((lon + 180) / (F.lit(360.0) / n)).cast("long"), n)

    def cell(self, lat: Column, lon: Column) -> Column:
        b = self.band(lat)
        return F.shiftleft(b, 32) + self._column(b, lon)

    def around(self, lat: Column, lon: Column) -> Column:
        """An array of the cells that may hold points within the distance."""
        b0 = self.band(lat)
        bands = F.sequence(F.greatest(b0 - 1, F.lit(0).cast("long")), F.least(b0 + 1, F.lit(self.top).cast("long")))
        # the widest difference of longitude within the distance; all longitudes if a pole is within it
        near_pole = F.abs(lat) + self.step >= 90
        ratio = F.lit(math.sin(min(self.angle, math.pi / 2))) / F.cos(F.radians(lat))
        wide = F.when(near_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.0001)

        def cells(b: Column) -> Column:
            n = self._count(b)
            w = F.lit(360.0) / n
            lo, hi = F.floor((lon - wide + 180) / w).cast("long"), F.floor((lon + wide + 180) / w).cast("long")
            return F.transform(F.sequence(lo, F.least(hi, lo + n - 1)), lambda c: F.shiftleft(b, 32) + F.pmod(c, n))

        return F.array_distinct(F.flatten(F.transform(bands, cells)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def wkt_polygons(wkt: Column) -> Column:
    """Rings of a WKT point, polygon or multipolygon: array (polygons) of array (rings, the first the outer) of array of (x, y).

    A point is one polygon of one ring of one point. Null for null, empty, malformed or other geometry.
    """
    body = F.regexp_extract(F.trim(wkt), r"(?is)^(?:srid=\d+;)?\s*(?:multi)?(?:point|polygon)\s*(?:z|m|zm)?\s*(\(.*\))\s*$", 1)
    tight = F.regexp_replace(F.regexp_replace(body, r"\s*([(),])\s*", "$1"), r"^\(+|\)+$", "")

    def point(p: Column) -> Column:
        xy = F.split(p, r"\s+")
        return F.struct(F.try_element_at(xy, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(xy, F.lit(2)).try_cast("double").alias("y"))

    def parse(tight: Column) -> Column:
        return F.transform(F.split(tight, r"\)\),\(\("), lambda p: F.transform(F.split(p, r"\),\("), lambda r: F.transform(F.split(r, ","), point)))

    def sound(rings: Column) -> Column:
        return F.when(F.forall(F.flatten(F.flatten(rings)), lambda p: p["x"].isNotNull() & p["y"].isNotNull()), rings)

    return let(tight, lambda t: F.when(t != "", let(parse(t), sound)))


def _ring_sums(ring: Column) -> Column:
    """(a, cx, cy): twice a ring's signed area, and six times its area's moments; relative to its first point."""
    o = ring[0]
    pairs = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def step(s: Column, e: Column) -> Column:
        x0, y0, x1, y1 = e["p"]["x"] - o["x"], e["p"]["y"] - o["y"], e["q"]["x"] - o["x"], e["q"]["y"] - o["y"]
        cross = x0 * y1 - x1 * y0
        return F.struct((s["a"] + cross).alias("a"), (s["cx"] + (x0 + x1) * cross).alias("cx"), (s["cy"] + (y0 + y1) * cross).alias("cy"))

    return F.aggregate(pairs, start, step)


def rings_area(polygons: Column) -> Column:
    """Planar area of the polygons, holes taken off."""

    def one(rings: Column) -> Column:
        areas = F.transform(rings, lambda r: F.abs(_ring_sums(r)["a"]) / 2)
        return 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)

    return F.aggregate(F.transform(polygons, one), F.lit(0.0), lambda s, a: s + a)


def rings_centroid(polygons: Column) -> Column:
    """(x, y): planar centroid by area, holes taken off; of shapes without area, the mean of their points."""

    def of_ring(ring: Column, i: Column) -> Column:
        def moments(s: Column) -> Column:
            o, sign = ring[0], F.signum(s["a"]) * F.when(i == 0, 1.0).otherwise(-1.0)
            return F.struct((sign * s["a"] / 2).alias("a"), (sign * (s["cx"] / 6 + o["x"] * s["a"] / 2)).alias("x"), (sign * (s["cy"] / 6 + o["y"] * s["a"] / 2)).alias("y"))

        return let(_ring_sums(ring), moments)

    def total(parts: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        return F.aggregate(parts, zero, lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))

    def centre(s: Column) -> Column:
        return F.struct((s["x"] / s["a"]).alias("x"), (s["y"] / s["a"]).alias("y"))

    def of(shape: Column) -> Column:
        by_area = total(F.flatten(F.transform(shape, lambda rings: F.transform(rings, of_ring))))
        points = F.transform(F.flatten(F.flatten(shape)), lambda p: F.struct(F.lit(1.0).alias("a"), p["x"].alias("x"), p["y"].alias("y")))
        return let(by_area, lambda s: F.when(s["a"] > 0, centre(s)).otherwise(let(total(points), centre)))

    return let(polygons, lambda shape: F.when(shape.isNotNull(), of(shape)))


def ring_edges(polygons: Column) -> Column:
    """All edges (x0, y0, x1, y1) of all rings, horizontal ones left out."""

    def of_ring(r: Column) -> Column:
        pairs = F.arrays_zip(r.alias("p"), F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)).alias("q"))
        return F.transform(pairs, lambda e: F.struct(e["p"]["x"].alias("x0"), e["p"]["y"].alias("y0"), e["q"]["x"].alias("x1"), e["q"]["y"].alias("y1")))

    return F.filter(F.flatten(F.transform(F.flatten(polygons), of_ring)), lambda e: e["y0"] != e["y1"])


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside by the even-odd rule: a ray to the right crosses an odd number of edges."""
    crossings = F.filter(edges, lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]))
    return F.size(crossings) % 2 == 1
