"""Readers for the feeds' formats."""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header: byte order mark and blanks off the names, only the given columns read.

    Without a schema all columns are text; nothing is inferred, which would read the file twice.
    """
    df = spark.read.option("header", True).csv(path, schema=schema)
    df = df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of the Parquet tables that exists."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(p)
    return None


def header_rows(df: DataFrame, c: str, names: dict[str, str], id_parts: list[str], id_name: str = "geoid") -> DataFrame:
    """Rows of JSON arrays of arrays, the first of which names the columns (as census tables come).

    Columns are renamed by names, negative numbers (codes for missing) become null, and the id is its parts joined.
    """
    rows = df.select(F.from_json(c, "array<array<string>>").alias("r")).where("size(r) > 0").select(F.element_at("r", 1).alias("h"), F.explode(F.slice("r", 2, F.size("r"))).alias("v"))

    def cell(name: str) -> Column:
        at = F.array_position("h", name)
        return F.when(at > 0, F.try_element_at("v", at.cast("int")))

    def value(name: str) -> Column:
        x = cell(name).try_cast("double")
        return F.when(x >= 0, x)

    return rows.select(F.concat(*[cell(p) for p in id_parts]).alias(id_name), *[value(a).alias(b) for a, b in names.items()])


def map_elements(df: DataFrame, c: str, category: Column) -> DataFrame:
    """(osm_id, category, subcategory, name, latitude, longitude) of answers of a map service: nodes by their place, others by their centre; the first tag that isn't empty is the subcategory."""
    tags = "map<string,string>"
    e = df.select("*", F.explode(F.from_json(c, f"elements array<struct<id:bigint,type:string,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:{tags}>>")["elements"]).alias("e"))
    kinds = [F.nullif(F.col("e.tags")[k], F.lit("")) for k in ("amenity", "shop", "leisure", "highway", "railway")]
    lat, lon = F.coalesce("e.lat", "e.center.lat"), F.coalesce("e.lon", "e.center.lon")
    out = e.select(F.col("e.id").alias("osm_id"), category.alias("category"), F.coalesce(*kinds, F.lit("")).alias("subcategory"), F.col("e.tags")["name"].alias("name"), lat.alias("latitude"), lon.alias("longitude"))
    return out.where("latitude is not null and longitude is not null")


def search_results(df: DataFrame, c: str) -> DataFrame:
    """Homes in answers of a listing search, behind their guarding prefix: eight fields each."""
    fields = {"address": "streetLine", "city_name": "city", "state": "state", "zip": "zip", "latitude": "latLong", "longitude": "latLong", "price": "price", "url": "url"}
    text = "struct<value:string>"
    homes = f"payload struct<homes:array<struct<streetLine:{text},city:string,state:string,zip:string,latLong:struct<value:struct<latitude:double,longitude:double>>,price:struct<value:double>,url:string>>>"
    h = df.select(F.explode(F.from_json(F.regexp_replace(F.col(c), r"^\{\}&&", ""), homes)["payload"]["homes"]).alias("h"))
    pick = {"address": "h.streetLine.value", "latitude": "h.latLong.value.latitude", "longitude": "h.latLong.value.longitude", "price": "h.price.value"}
    return h.select(*[F.col(pick.get(k, f"h.{v}")).alias(k) for k, v in fields.items()])


class _Finder(HTMLParser):
    """Text of the first element that one of the rules takes, the earlier rule before the later."""

    RULES = (lambda t, a: a.get("id") == "marketing-remarks-scroll", lambda t, a: "remarks" in a.get("class", "").lower(), lambda t, a: t == "p" and "description" in a.get("class", "").lower())
    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[int, int]] = []
        self.found: list[list[str] | None] = [None] * len(self.RULES)
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        self.depth += 1
        a = {k: v or "" for k, v in attrs}
        for i, rule in enumerate(self.RULES):
            if self.found[i] is None and rule(tag, a):
                self.found[i] = []
                self.open.append((i, self.depth))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.VOID:
            self.open = [(i, d) for i, d in self.open if d < self.depth]
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        for i, _ in self.open:
            self.found[i].append(data)


@F.pandas_udf(StringType())
def page_description(pages: pd.Series) -> pd.Series:
    """The description in a listing's page, white space squeezed; null without one."""

    def one(page: str | None) -> str | None:
        if not page:
            return None
        f = _Finder()
        f.feed(page)
        texts = (re.sub(r"\s+", " ", " ".join(t)).strip() for t in f.found if t is not None)
        return next((t for t in texts if t), None)

    return pages.map(one)


def import_descriptions(old: DataFrame, new: DataFrame, required: list[str], defaults: dict[str, str], key: str, least: int = 50) -> DataFrame:
    """old and new descriptions, new ones longer than ``least``, with defaults for missing columns, one for each key, old ones first."""
    missing = [c for c in required if c not in new.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    for c, v in defaults.items():
        if c not in new.columns:
            new = new.withColumn(c, F.lit(v))
    both = old.withColumn("_age", F.lit(0)).unionByName(new.where(F.length("description") > least).withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_age")]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_age", *[F.col(c).cast("string") for c in rest])).alias("_r")).select(key, *[f"_r.{c}" for c in rest])


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row, emb) of a file of vectors, .npy or CSV without a header; read in one task, as such files come from one machine."""
    if not path.endswith(".npy"):
        lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id())
        return lines.select("row", F.transform(F.split("value", ","), lambda x: x.try_cast("double")).alias("emb"))
    import io

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                m = np.load(io.BytesIO(content)).astype(float)
                yield pd.DataFrame({"row": np.arange(len(m)), "emb": list(m)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row bigint, emb array<double>")


def wkb_to_wkt(b: bytes) -> str:
    """Well-known text of well-known binary points, polygons and multipolygons."""

    def numbers(at: int, end: str, n: int) -> tuple:
        return struct.unpack_from(f"{end}{n}d", b, at)

    def ring(at: int, end: str) -> tuple[str, int]:
        (n,) = struct.unpack_from(f"{end}I", b, at)
        xy = numbers(at + 4, end, 2 * n)
        return "(" + ", ".join(f"{xy[2 * i]!r} {xy[2 * i + 1]!r}" for i in range(n)) + ")", at + 4 + 16 * n

    def shape(at: int) -> tuple[int, str, int]:
        end = "<" if b[at] else ">"
        (kind,) = struct.unpack_from(f"{end}I", b, at + 1)
        if kind % 1000 == 1:
            x, y = numbers(at + 5, end, 2)
            return 1, f"({x!r} {y!r})", at + 21
        (n,) = struct.unpack_from(f"{end}I", b, at + 5)
        parts, at = [], at + 9
        for _ in range(n):
            if kind % 1000 == 3:
                text, at = ring(at, end)
            elif kind % 1000 == 6:
                _, text, at = shape(at)
            else:
                raise ValueError(f"geometry of kind {kind} isn't read")
            parts.append(text)
        return kind % 1000, "(" + ", ".join(parts) + ")", at

    kind, text, _ = shape(0)
    return {1: "POINT ", 3: "POLYGON ", 6: "MULTIPOLYGON "}[kind] + text


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(low)
        self.low, self.high = low, high


class GeoPackage(DataSource):
    """spark.read.format("geopackage").option("path", ...).option("layer", ...): a layer, its geometry as text.

    The file lies where all executors can read it. Ranges of row ids are read side by side ("parts", 8).
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path'].removeprefix('file://')}?mode=ro", uri=True)

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}
        with self._open() as c:
            cols = c.execute(f'pragma table_info("{self.options["layer"]}")').fetchall()
        return ", ".join(f"`{n}` {kinds.get(t.upper().split('(')[0], 'string')}" for _, n, t, *_ in cols)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GeoReader(self, schema)


class _GeoReader(DataSourceReader):
    def __init__(self, source: GeoPackage, schema: StructType):
        self.source, self.names = source, schema.fieldNames()

    def partitions(self) -> list[_Rows]:
        with self.source._open() as c:
            low, high = c.execute(f'select min(rowid), max(rowid) from "{self.source.options["layer"]}"').fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // int(self.source.options.get("parts", "8"))))
        return [_Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        layer = self.source.options["layer"]
        with self.source._open() as c:
            geo = {r[0] for r in c.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,))}
            names = ", ".join(f'"{n}"' for n in self.names)
            for row in c.execute(f'select {names} from "{layer}" where rowid >= ? and rowid < ?', (part.low, part.high)):
                yield tuple(self.text(v) if n in geo and v is not None else v for n, v in zip(self.names, row))

    @staticmethod
    def text(v: bytes) -> str:
        return wkb_to_wkt(v[8 + (0, 32, 48, 48, 64)[(v[3] >> 1) & 7] :])


class Shapes(DataSource):
    """spark.read.format("shapes").option("path", "...zip or .shp"): polygons of a shapefile as text, with the attributes beside it. One file is one task."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def parts(self) -> tuple[bytes, bytes]:
        path = self.options["path"].removeprefix("file://")
        if path.endswith(".zip"):
            import zipfile

            with zipfile.ZipFile(path) as z:
                stem = next(n for n in z.namelist() if n.endswith(".shp"))[:-4]
                return z.read(stem + ".shp"), z.read(stem + ".dbf")
        with open(path, "rb") as s, open(path[:-4] + ".dbf", "rb") as d:
            return s.read(), d.read()

    @staticmethod
    def fields(dbf: bytes) -> list[tuple[str, str, int]]:
        out, at = [], 32
        while dbf[at] != 13:
            out.append((dbf[at : at + 11].split(b"\0")[0].decode(), chr(dbf[at + 11]), dbf[at + 16]))
            at += 32
        return out

    def schema(self) -> str:
        kinds = {"N": "double", "F": "double"}
        return ", ".join([f"`{n}` {kinds.get(k, 'string')}" for n, k, _ in self.fields(self.parts()[1])] + ["geometry string"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShapeReader(self)


class _ShapeReader(DataSourceReader):
    def __init__(self, source: Shapes):
        self.source = source

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        shp, dbf = self.source.parts()
        fields = self.source.fields(dbf)
        head, size = struct.unpack_from("<HH", dbf, 8)
        at, i = 100, 0
        while at < len(shp):
            (words,) = struct.unpack_from(">I", shp, at + 4)
            row, o = [], head + i * size + 1
            for _, kind, width in fields:
                v = dbf[o : o + width].decode("latin-1").strip()
                row.append((float(v) if v else None) if kind in "NF" else v or None)
                o += width
            yield (*row, self.polygon(shp, at + 8))
            at, i = at + 8 + 2 * words, i + 1

    @staticmethod
    def polygon(shp: bytes, at: int) -> str | None:
        (kind,) = struct.unpack_from("<I", shp, at)
        if kind % 10 != 5:
            return None
        parts, points = struct.unpack_from("<II", shp, at + 36)
        starts = [*struct.unpack_from(f"<{parts}I", shp, at + 44), points]
        xy = np.frombuffer(shp, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
        shapes: list[list[str]] = []
        for a, b in zip(starts, starts[1:]):
            r = xy[a:b]
            text = "(" + ", ".join(f"{x!r} {y!r}" for x, y in r.tolist()) + ")"
            turn = (r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()
            if turn <= 0 or not shapes:  # outer rings run clockwise
                shapes.append([text])
            else:
                shapes[-1].append(text)
        return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(s) + ")" for s in shapes) + ")"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    from lotweave.sources.paged import PagedTable

    for s in (GeoPackage, Shapes, PagedTable):
        spark.dataSource.register(s)
