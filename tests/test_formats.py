"""The command line, requests and downloads."""

import http.server
import threading

import pytest

from lotweave import __main__ as cli
from lotweave.operators import identification as idn
from lotweave.sources import requests as rq


def test_plan_and_unknown_names():
    assert set(cli.plan("all", None, ["p2_filled"])) <= set(cli.known()) and "p2_filled" not in cli.plan("all", None, ["p2_filled"])
    assert all(set(qs) <= set(cli.known()) for qs in cli.COMMANDS.values())
    with pytest.raises(SystemExit):
        cli.plan("query", ["absent"], None)


def test_command_writes_results(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["query", "--tables", folder, "--out", out, "--only", "match_rates", "fold_sizes", "--city", "sf"], spark) == 0
    assert [r["city"] for r in spark.read.json(f"{out}/match_rates.json").collect()] == ["sf"]
    assert spark.read.parquet(f"{out}/fold_sizes").count() == 5
    assert cli.main(["query", "--tables", str(tmp_path), "--out", out, "--only", "match_rates"], spark) == 1
    (tmp_path / "d.csv").write_text("address,description\nX 1," + "long " * 20 + "\n")
    assert cli.main(["import", "--tables", folder, "--out", out, "--file", str(tmp_path / "d.csv")], spark) == 0
    assert spark.read.parquet(f"{out}/descriptions").where("address = 'X 1'").count() == 1


def test_download_once(tmp_path):
    class Files(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a" else 404)
            self.end_headers()
            self.wfile.write(b"x" * 3000)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    at = tmp_path / "a"
    assert rq.download(f"{url}/a", str(at), 1000) and at.stat().st_size == 3000 and not rq.download(f"{url}/a", str(at))
    with pytest.raises(OSError):
        rq.download(f"{url}/b", str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()
    server.shutdown()
    assert rq.shapes_url(2022, "25") == "https://www2.census.gov/geo/tiger/TIGER2022/BG/tl_2022_25_bg.zip"


def test_directed_paths_and_backdoor_sets():
    assert idn.directed_paths(idn.GRAPH, "T", "Y") == [] and ["L", "T"] in idn.directed_paths(idn.GRAPH, "L", "T")
    assert idn.is_backdoor_set(idn.GRAPH, "T", "Y", {"L", "X", "C"}) and not idn.is_backdoor_set(idn.GRAPH, "T", "Y", {"L"})
    assert not idn.is_backdoor_set([("T", "M"), ("M", "Y")], "T", "Y", {"M"})
