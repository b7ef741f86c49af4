"""Sources as one scan of many files, pages from a server that fails, and documents written by the executors."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import clean
from tallyloom.sources import html, pages, registry, sinks, tables

FILES = 3000


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    root = tmp_path_factory.mktemp("many") / "raw"
    for k in range(FILES):
        folder = root / f"board {k}"
        folder.mkdir(parents=True)
        (folder / "data.csv").write_bytes(f"Model,Score,task\n{'模型' if k % 3 == 0 else 'm'}{k},{k}%,\nx,\"a, b\"\n".encode("gbk" if k % 2 else "utf-8"))
    return str(root)


def test_many_small_files_are_one_scan(spark, many):
    """Files of two encodings: one stage of few tasks, no frame or job for each file, and content never shuffled."""
    found = tables.read_board_files(spark, many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan binaryFile") == 1 and "Exchange" not in plan and "Union" not in plan
    assert found.rdd.getNumPartitions() < FILES / 5
    rows = {(r.benchmark_id, r.row_no): r.cells for r in found.collect()}
    assert len(rows) == 2 * FILES
    assert rows["board 3", 0] == {"Model": "模型3", "Score": "3%", "task": None} and rows["board 4", 1] == {"Model": "x", "Score": "a, b", "task": None}
    boards = clean.read_boards(spark, many, canonical={"board 7": "seven"})
    got = {(r.benchmark_id, r.row_no): r for r in boards.collect()}
    assert len(got) == 2 * FILES and got["seven", 0].score_raw == "7%" and got["board 9", 0].model_raw == "模型9"


def test_odd_files(spark, tmp_path):
    def put(name, raw):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.csv").write_bytes(raw)

    put("bom", b"\xef\xbb\xbfModel,Score\r\na,1\r\n")
    put("ragged", b"Model,,Model,Score\n\na\nb,1,2,3,4\n")
    put("head", b"Model,Score\n")
    put("empty", b"")
    put("lines", b'Model,Score\n"two\nlines, ""q""",5\n')
    put("long", b"Model,Score\n" + b"".join(b"m%d,%d\n" % (i, i) for i in range(20_000)))
    rows = tables.read_board_files(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.row_no):
        by.setdefault(r.benchmark_id, []).append(r.cells)
    assert by["bom"] == [{"Model": "a", "Score": "1"}]
    assert by["ragged"] == [{"Model": "a", "_c1": None, "Model.1": None, "Score": None}, {"Model": "b", "_c1": "1", "Model.1": "2", "Score": "3"}]
    assert by["lines"][0]["Model"] == 'two\nlines, "q"' and "head" not in by and "empty" not in by
    assert [c["Score"] for c in by["long"]] == [str(i) for i in range(20_000)]
    raw = clean.read_boards(spark, str(tmp_path)).where("benchmark_id = 'long'")
    assert raw.agg(F.count("row_no"), F.countDistinct("row_no"), F.max("row_no")).first()[:] == (20_000, 20_000, 19_999)
    with pytest.raises(FileNotFoundError):
        tables.read_board_files(spark, str(tmp_path), "none.csv")
    put("nothing", b"Model,Price\na,1\n")
    with pytest.raises(Exception, match="no model or no score column"):
        clean.read_boards(spark, str(tmp_path)).collect()


class Server(BaseHTTPRequestHandler):
    asked: Counter = Counter()
    open_now, most_open, lock = 0, 0, threading.Lock()

    def do_GET(self):  # noqa: N802
        with self.lock:
            Server.asked[self.path] += 1
            Server.open_now += 1
            Server.most_open = max(Server.most_open, Server.open_now)
            k = Server.asked[self.path]
        time.sleep(0.02)
        code = 404 if "gone" in self.path else 503 if "busy" in self.path and k < 3 else 500 if "broken" in self.path else 200
        with self.lock:
            Server.open_now -= 1
        self.send_response(code)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        if code == 200:
            self.wfile.write(f"<table><tr><th>Other</th></tr></table><table><tr><th>Model</th><th>Score</th></tr><tr><td>é{self.path}</td><td>1</td></tr></table>".encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    Server.asked.clear()
    Server.most_open = 0
    made = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_pages_with_failures(spark, server):
    names = [*[f"ok{i}" for i in range(30)], "busy", "gone", "broken"]
    listed = spark.createDataFrame([*[(n, f"{server}/{n}", i) for i, n in enumerate(names)], ("null", None, 99), ("bad", "no address", 98)], "benchmark_id string, url string, extra int")
    found = {r.benchmark_id: r for r in pages.fetch_pages(listed, pause=0.01).collect()}
    assert len(found) == 35 and found["ok3"].extra == 3 and "é/ok3" in found["ok3"].content and found["ok3"].tries == 1
    assert found["busy"].error is None and found["busy"].tries == 3
    assert found["gone"].error.startswith("404") and found["gone"].tries == 1 and found["gone"].content is None
    assert found["broken"].error.startswith("500") and found["broken"].tries == pages.TRIES
    assert found["null"].content is None and found["null"].error is None and found["bad"].error
    assert Server.asked["/ok0"] == 1 and Server.most_open <= pages.PER_HOST


def test_tables_at_addresses(spark, server, tmp_path):
    listed = spark.createDataFrame([("Other", f"{server}/a"), ("gone", f"{server}/gone")], "benchmark_id string, url string")
    got = html.wide(registry.read_urls(listed, best=True, skip=True), ["Model", "Score"]).collect()
    assert [(r.benchmark_id, r.Model, r.Score) for r in got] == [("Other", "é/a", "1")]
    with pytest.raises(Exception, match="404"):
        registry.read_urls(listed).collect()
    (tmp_path / "urls.json").write_text(json.dumps({"x": f"{server}/x", "y": f"{server}/y"}))
    assert registry.read_source("url", spark, str(tmp_path)).count() == 0  # the first table has no rows


def test_documents_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(f'k"{i:04}\n', i / 3, None if i % 2 else [{"a": float(i)}], {"m": None if i % 5 else i}) for i in range(500)], "key string, x double, y array<struct<a: double>>, m map<string, int>").repartition(7)
    path = f"{tmp_path}/doc.json"
    sinks.write_json_document(rows, "key", path)
    sinks.write_json_document(rows, "key", path)  # over itself
    text = open(path, encoding="utf-8").read()
    found = json.loads(text)
    assert list(found) == sorted(found) and len(found) == 500 and found['k"0004\n'] == {"x": 4 / 3, "y": [{"a": 4.0}], "m": {"m": None}} and "y" not in found['k"0005\n']
    sinks.write_json_document(rows.limit(0), "key", f"{tmp_path}/none.json")
    assert json.load(open(f"{tmp_path}/none.json")) == {}
    with pytest.raises(Exception, match="isn't finite"):
        sinks.write_json_document(spark.createDataFrame([("k", [float("inf")])], "key string, a array<double>"), "key", f"{tmp_path}/bad.json")
    texts = spark.createDataFrame([("a b", "x\ny"), ("c", "é")], "f string, t string")
    sinks.write_files(texts, "f", "t", f"{tmp_path}/files", F.lit("latin-1"))
    files = tables.discover(spark, f"{tmp_path}/files", "*.txt").collect()
    assert {r.benchmark_id: bytes(r.content) for r in files} == {"a b": b"x\ny\n", "c": b"\xe9\n"}
