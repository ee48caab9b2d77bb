"""The resumable fetch with a made transport that keeps a log of what it is asked for."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from termlens.operators import grounding
from termlens.sources import catalogs, fetch, versions

PAGES = {"a": 7, "b": 1, "c": 4, "broken": 3}


def client(log, slow=0.0, fail=True):
    def make():
        def get(address):
            with open(f"{log}/log.txt", "a") as f:
                f.write(address + "\n")
            time.sleep(slow)
            path, n = address.split("/")
            if fail and path == "broken" and n == "1":
                raise ConnectionError("no answer")
            return json.dumps({"at": address}), f"{path}/{int(n) + 1}" if int(n) + 1 < PAGES[path] else None

        return get

    return make


def asked(log):
    return (log / "log.txt").read_text().split() if (log / "log.txt").exists() else []


@pytest.fixture
def paths(spark):
    return spark.createDataFrame([(p, f"{p}/0") for p in PAGES] + [("a", "a/0"), (None, "x/0"), ("y", None)], "path string, address string")


def test_stops_in_time_and_goes_on_without_a_second_request(spark, tmp_path, paths):
    folder = str(tmp_path / "pages")
    open_, runs = None, 0
    while open_ is None or (open_ and runs < 12):
        began = time.time()
        open_ = {r["path"]: r["address"] for r in fetch.run(spark, paths, folder, client(tmp_path, slow=0.4, fail=False), seconds=4.0, delay=0.1, tasks=2).collect()}
        assert time.time() - began < 30
        runs += 1
    log = asked(tmp_path)
    assert not open_ and runs > 1
    assert sorted(log) == sorted(f"{p}/{n}" for p, k in PAGES.items() for n in range(k))
    got = fetch.pages(spark, folder).collect()
    assert sorted((r["path"], r["n"], json.loads(r["body"])["at"]) for r in got) == sorted((p, n, f"{p}/{n}") for p, k in PAGES.items() for n in range(k))
    assert len({r["run"] for r in got}) == runs or len({r["run"] for r in got}) > 1


def test_failures_wait_for_the_next_run(spark, tmp_path, paths):
    folder = str(tmp_path / "pages")
    left = fetch.run(spark, paths, folder, client(tmp_path), 60.0, 0.0).collect()
    assert [tuple(r) for r in left] == [("broken", 1, "broken/1")]
    bad = fetch.pages(spark, folder).where("error is not null").collect()
    assert [(r["path"], r["n"], r["body"]) for r in bad] == [("broken", 1, None)] and "no answer" in bad[0]["error"]
    before = len(asked(tmp_path))
    assert fetch.run(spark, paths, folder, client(tmp_path, fail=False), 60.0, 0.0).collect() == []
    assert asked(tmp_path)[before:] == ["broken/1", "broken/2"]
    assert fetch.run(spark, paths, folder, client(tmp_path), 60.0, 0.0).collect() == [] and len(asked(tmp_path)) == before + 2


def test_nothing_without_time_and_a_dead_run_leaves_nothing(spark, tmp_path, paths):
    folder = str(tmp_path / "pages")
    assert fetch.run(spark, paths, folder, client(tmp_path), 0.0).count() == 4 and asked(tmp_path) == []

    def dying():
        raise RuntimeError("worker gone")

    with pytest.raises(Exception, match="worker gone"):
        fetch.run(spark, paths, folder, dying, 60.0)
    assert fetch.pages(spark, folder).count() == 0 and versions.manifest(spark, folder)["parts"] == []
    assert fetch.still_open(paths.where("path = 'a'"), fetch.pages(spark, folder)).select(F.col("address")).first()[0] == "a/0"


@pytest.fixture
def server():
    """A local server: pages of catalogs, a linked list, and a model that answers slowly when asked to."""

    class Answers(http.server.BaseHTTPRequestHandler):
        def answer(self, text, status=200, kind="text/html; charset=latin-1"):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            try:
                self.wfile.write(text.encode("latin-1"))
            except OSError:
                pass  # the client has gone

        def do_GET(self):
            if self.path == "/gone":
                self.answer("", 404)
            elif self.path.startswith("/list"):
                n = int(self.path[5:])
                self.answer(json.dumps({"items": [n], "_links": {"next": f"http://127.0.0.1:{self.server.server_port}/list{n + 1}" if n < 2 else None}}))
            else:
                self.answer(f"<b>CSE 23{self.path[-1]}: Größe</b><ul><li>Page {self.path}</li></ul>")

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "wait" in asked["prompt"]:
                time.sleep(3)
            self.answer(json.dumps({"response": f"{asked['model']}: {asked['prompt']}", "stream": asked["stream"]}))

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_catalogs_are_fetched_page_by_page(spark, tmp_path, server):
    sites = spark.createDataFrame([("p", "code_item", f"{server}/1"), ("p", "code_item", f"{server}/2"), ("q", "code_item", f"{server}/gone"), ("r", "no layout", f"{server}/3"), ("s", "code_item", None)], "program string, layout string, url string")
    for _ in range(2):
        found = catalogs.fetched(spark, sites, str(tmp_path / "pages"), fetch.whole_pages(timeout=5), seconds=60.0, delay=0.0)
        rows = found.collect()
        assert sorted((r["program"], r["course_code"], r["course_name"], r["description"]) for r in rows if r["error"] is None) == [("p", "CSE 231", "Größe", "Page /1"), ("p", "CSE 232", "Größe", "Page /2")]
        assert {r["program"]: r["error"].split(":")[0] for r in rows if r["error"]} == {"q": "HTTPError", "r": "KeyError"}
    assert fetch.pages(spark, str(tmp_path / "pages")).where("error is null").count() == 3


def test_linked_pages_and_a_slow_model(spark, tmp_path, server):
    from termlens.sources import rest

    start = spark.createDataFrame([("list", f"{server}/list0")], "path string, address string")
    fetch.run(spark, start, str(tmp_path / "list"), fetch.linked_pages(rest.http_json, "_links.next"), 60.0, 0.0)
    assert [json.loads(r["body"])["items"] for r in fetch.pages(spark, str(tmp_path / "list")).orderBy("n").collect()] == [[0], [1], [2]]
    prompts = spark.createDataFrame([(1, "name it"), (2, "wait for it")], "item_id long, prompt string")
    got = {r["item_id"]: r for r in grounding.ask(prompts, grounding.local_model(f"{server}/api", "small", timeout=1.0)).collect()}
    assert got[1]["answer"] == "small: name it" and got[1]["call_succeeded"]
    assert not got[2]["call_succeeded"] and "imed out" in got[2]["error"]
