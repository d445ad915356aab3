"""Readers and writers on small files, streams on small folders, the paged service on a local server."""

import json
import sqlite3
import struct
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotweave.sources import readers as rd
from lotweave.sources import writers as wr
from lotweave.streaming import feeds


@pytest.fixture(scope="module")
def formats(spark):
    rd.register(spark)
    return spark


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿PID , price\n1,$5\n".encode())
    df = rd.read_csv(spark, str(tmp_path / "a.csv"), columns=["PID", "absent"])
    assert df.columns == ["PID"] and df.first()["PID"] == "1"


def test_census_rows(spark):
    text = json.dumps([["B1", "state", "tract"], ["10", "25", "01"], ["-666", "25", "02"]])
    got = rd.header_rows(spark.createDataFrame([(text,), ("[]",), (None,)], "j string"), "j", {"B1": "income", "B9": "gone"}, ["state", "tract"]).collect()
    assert [(r["geoid"], r["income"], r["gone"]) for r in got] == [("2501", 10.0, None), ("2502", None, None)]


def test_map_elements(spark):
    answer = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "", "shop": "mall"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "n"}}, {"type": "way", "id": 3}]}
    got = rd.map_elements(spark.createDataFrame([(json.dumps(answer),)], "j string"), "j", F.lit("retail")).collect()
    assert [(r["osm_id"], r["subcategory"], r["latitude"]) for r in got] == [(1, "mall", 1.0), (2, "", 3.0)]


def test_search_results(spark):
    answer = "{}&&" + json.dumps({"payload": {"homes": [{"streetLine": {"value": "1 Oak"}, "city": "X", "latLong": {"value": {"latitude": 1.0, "longitude": 2.0}}, "price": {"value": 9.0}, "url": "/u"}]}})
    r = rd.search_results(spark.createDataFrame([(answer,)], "j string"), "j").first()
    assert (r["address"], r["city_name"], r["latitude"], r["price"], r["url"], r["zip"]) == ("1 Oak", "X", 1.0, 9.0, "/u", None)


def test_pages(spark):
    pages = ['<p class="Description">b</p><div class="house-Remarks">a <i>c</i></div>', '<div id="marketing-remarks-scroll">x</div>', "<p>none</p>", None, ""]
    got = spark.createDataFrame([(p,) for p in pages], "p string").select(rd.page_description("p")).collect()
    assert [r[0] for r in got] == ["a c", "x", None, None, None]


def test_import(spark):
    old = spark.createDataFrame([("a", "old", "s")], "address string, description string, source string")
    new = spark.createDataFrame([("a", "n" * 60), ("b", "m" * 60), ("c", "short")], "address string, description string")
    got = {r["address"]: (r["description"], r["source"]) for r in rd.import_descriptions(old, new, ["address"], {"source": ""}, "address").collect()}
    assert got == {"a": ("old", "s"), "b": ("m" * 60, "")}
    with pytest.raises(ValueError):
        rd.import_descriptions(old, new, ["zip"], {}, "address")


def test_vectors(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(3, 2))
    got = rd.load_vectors(spark, str(tmp_path / "v.npy")).orderBy("row").collect()
    assert [list(r["emb"]) for r in got] == [[0, 1], [2, 3], [4, 5]]


def test_geopackage(formats, tmp_path):
    wkb = struct.pack("<BIIIdddddd", 1, 3, 1, 3, 0, 0, 1, 0, 0, 1)
    blob = b"GP\0\x01" + struct.pack("<i", 4326) + wkb
    with sqlite3.connect(tmp_path / "a.gpkg") as c:
        c.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        c.execute("insert into gpkg_geometry_columns values ('city', 'geom')")
        c.execute("create table city (fid integer primary key, geom blob, area double, name text)")
        c.executemany("insert into city values (?, ?, ?, ?)", [(i, blob if i % 2 else None, i / 2, f"n{i}") for i in range(1, 21)])
    df = formats.read.format("geopackage").option("layer", "city").option("parts", 3).load(str(tmp_path / "a.gpkg"))
    rows = df.orderBy("fid").collect()
    assert len(rows) == 20 and rows[0]["geom"] == "POLYGON ((0.0 0.0, 1.0 0.0, 0.0 1.0))" and rows[1]["geom"] is None and rows[2]["area"] == 1.5


def test_shapes(formats, tmp_path):
    ring = [(0, 0), (0, 1), (1, 1), (0, 0)]
    body = struct.pack("<I4dII I", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = bytes(100) + struct.pack(">II", 1, len(body) // 2) + body
    field = b"GEOID".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4]) + bytes(15)
    dbf = struct.pack("<B3xIHH20x", 3, 1, 32 + 32 + 1, 5) + field + b"\r" + b" 0250"
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("x.shp", shp)
        z.writestr("x.dbf", dbf)
    r = formats.read.format("shapes").load(str(tmp_path / "s.zip")).first()
    assert r["GEOID"] == "0250" and r["geometry"] == "MULTIPOLYGON (((0.0 0.0, 0.0 1.0, 1.0 1.0, 0.0 0.0)))"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    wr.write_parts(df, str(tmp_path / "p"), ["k"])
    wr.append_csv(df, str(tmp_path / "c"))
    wr.append_csv(df, str(tmp_path / "c"))
    wr.write_report(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and rd.read_csv(spark, str(tmp_path / "c")).count() == 4
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert r"a\_b & 0.5000 \\" in wr.latex_table([{"k": "a_b", "v": 0.5}], {"k": "K", "v": "V"})


@pytest.fixture()
def service():
    failures = [0]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(p.split("=") for p in self.path.split("?")[1].split("&"))
            if q["offset"] == "10" and failures[0] < 1:
                failures[0] += 1
                self.send_error(500)
                return
            rows = [{"id": i, "v": f"x{i}"} for i in range(25)][int(q["offset"]) : int(q["offset"]) + int(q["limit"])]
            body = json.dumps({"result": {"records": rows}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?limit={{limit}}&offset={{offset}}"
    server.shutdown()


def test_paged(formats, service, tmp_path):
    read = {"url": service, "page": "10", "rows": "25", "records": "result.records", "wait": "0.01"}
    df = formats.read.format("paged").schema("id string, v string").options(**read).load()
    assert sorted(int(r["id"]) for r in df.collect()) == list(range(25))
    stream = formats.readStream.format("paged").schema("id string, v string").options(**read).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert formats.read.parquet(str(tmp_path / "out")).select("id").distinct().count() >= 10


def test_streams(spark, tmp_path):
    rows = [("m1", "2024-01-01 00:00:00", 1), ("m1", "2024-01-01 01:00:00", 2), ("m2", "2024-01-03 00:00:00", 3)]
    src = spark.createDataFrame(rows, "url string, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert drain(feeds.unique_deliveries(stream, ["url"], "t"), "uniq", "append").count() == 2
    assert drain(feeds.trailing_counts(stream, "t", ["url"], "2 days", "1 day"), "trail", "update").count() > 0
    q = feeds.keep_latest(stream, str(tmp_path / "tab"), "url", ["t", "v"], str(tmp_path / "ck2"))
    q.processAllAvailable()
    q.stop()
    assert {(r["url"], r["v"]) for r in spark.read.parquet(str(tmp_path / "tab/v=0")).collect()} == {("m1", 2), ("m2", 3)}
