"""The API source against a local server, page plans, comparisons, labels."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanlens.functions import labels
from scanlens.operators import compare
from scanlens.plans import paging
from scanlens.plans.files import Folder, new_run, stamp
from scanlens.plans.sample import pull
from scanlens.sources.api import ApiError, fetch_page, page_url, read_api

from .fixtures import item


class Handler(BaseHTTPRequestHandler):
    last, fails, asked = 10, {}, []

    def do_GET(self):
        url = urlparse(self.path)
        page = int(parse_qs(url.query)["page"][0])
        Handler.asked.append(self.path)
        left = Handler.fails.get(page, 0)
        if left:
            Handler.fails[page] = left - 1
            self.send_response(500)
            self.end_headers()
            return
        name = url.path.strip("/")
        body = {"_items": [item(name, f"{name}-{page}-{i}") for i in range(2)] if page <= Handler.last else []}
        if page < Handler.last:
            body["_links"] = {"next": {}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_urls():
    assert page_url("http://x/", "T1w", 3, 500, {"b": 1, "a": 0}) == "http://x/T1w?page=3&max_results=50&projection=%7B%22a%22%3A0%2C%22b%22%3A1%7D"


def test_tries(base):
    Handler.fails[3] = 2
    assert len(fetch_page(base, "T1w", 3, wait=0.01).payload["_items"]) == 2
    Handler.fails[3] = 3
    with pytest.raises(ApiError):
        fetch_page(base, "T1w", 3, wait=0.01)
    assert not Handler.fails[3]


def test_source(spark, base):
    assert [r.page for r in read_api(spark, base, "T1w", [1, 4], wait=0.01).orderBy("page").collect()] == [1, 4]
    Handler.fails[5] = 9
    got = read_api(spark, base, "T1w", [5], wait=0.01, on_error="keep").first()
    assert got.error and got.value is None
    Handler.fails[5] = 0


def test_pull(spark, base, tmp_path):
    Handler.fails[9] = 3
    got = pull(spark, base, str(tmp_path), modalities=["T1w"], count=3, name="r1", wait=0.001)
    Handler.fails[9] = 0
    run = tmp_path / "runs" / "r1"
    frontier = json.loads((run / "frontier" / "T1w.json").read_text())
    assert frontier["last"] == 8 and frontier["stopped_by"] == "empty"
    plan = json.loads((run / "plans" / "T1w.json").read_text())
    assert {p["page"] for p in plan} == {1, 2, 3, 4, 5, 6, 7, 8} and next(p for p in plan if p["page"] == 8)["reasons"] == ["linear", "probe", "tail"]
    assert got["modalities"]["T1w"]["items"] == 16 and len(list((run / "raw" / "T1w").iterdir())) == 8
    assert spark.read.json(str(run / "manifest" / "T1w-items.jsonl")).count() == 16 and spark.read.json(str(run / "manifest" / "T1w-pages.jsonl")).count() == 8


def test_evenly_spaced(spark):
    pages = lambda *a: sorted(r.page for r in paging.evenly_spaced(spark, *a).collect())
    assert pages(1, 100, 5) == [1, 26, 51, 75, 100] and pages(1, 3, 9) == [1, 2, 3] and pages(5, 5, 3) == [5] and pages(2, 1, 3) == pages(1, 5, 0) == []


def test_budget():
    assert paging.pages_wanted(3, 1, count=1536) == 1536 and paging.pages_wanted(3, 1, count=9, cap=4) == 4
    assert paging.pages_wanted(3, 1, gigabytes=1.0) == 128 and paging.pages_wanted(3, 10**12) == 1


def test_frontier_ends():
    class P:
        def __init__(self, items, next_=True, seconds=0.0):
            self.payload, self.seconds = {"_items": items, "_links": {"next": 1} if next_ else {}}, seconds

    assert paging.discover_frontier(lambda p: P([1], seconds=9.0)).stopped_by == "slow"
    assert paging.discover_frontier(lambda p: P([1], p < 4)).last == 4
    assert paging.discover_frontier(lambda p: P([1]), rounds=3).stopped_by == "rounds"

    def fails(p):
        raise ApiError("no")

    assert paging.discover_frontier(fails).to_dict()["probes"][0]["error"] == "no"


def test_files(tmp_path):
    from datetime import UTC, datetime
    from decimal import Decimal

    folder = new_run(str(tmp_path), "r") / "a"
    folder.put_json("b.json", {"z": Decimal("1.5"), "a": datetime(2020, 1, 1, tzinfo=UTC)})
    assert folder.name == f"{tmp_path}/runs/r/a"
    assert json.loads((tmp_path / "runs" / "r" / "a" / "b.json").read_text()) == {"z": 1.5, "a": "2020-01-01T00:00:00+00:00"}
    Folder(tmp_path.as_uri()).put("c.txt", "é")
    assert (tmp_path / "c.txt").read_bytes() == "é".encode()
    with pytest.raises(TypeError):
        folder.put_json("b.json", object())
    assert stamp(datetime(2026, 4, 16, 17, 59, 35, tzinfo=UTC).timestamp()) == "20260416T175935Z"


def test_view_and_metrics_of_a_comparison():
    assert compare.compared_view("series", True) == "raw" and compare.compared_view("series", False) == "series"
    assert compare.chosen_metrics(["a", "b", "a"]) == ["a", "b"] and len(compare.chosen_metrics([str(i) for i in range(30)])) == compare.MOST_METRICS


def test_display_range():
    a, b = {"min": 0, "max": 10, "p01": 1, "p99": 9, "p05": 2, "p95": 8}, {"min": -5, "max": 7, "p01": None, "p99": None}
    assert compare.display_range([a, b]) == (-5, 10) and compare.display_range([a, b], "p05_p95") == (-5, 8)
    assert compare.display_range([]) is None and compare.display_range([{"min": 1, "max": 1}]) is None


@settings(max_examples=40, deadline=None)
@given(st.floats(-100, 100), st.floats(0.1, 100), st.integers(1, 30))
def test_edges(low, width, bins):
    edges = compare.bucket_edges(low, low + width, bins)
    assert len(edges) == bins + 1 and edges[-1] == low + width and edges == sorted(edges)


def test_rebinning_keeps_the_count(spark):
    old = spark.createDataFrame([(0.0, 1.0, 4), (1.0, 3.0, 6), (2.0, 2.0, 5)], "start double, end double, count long")
    new = spark.createDataFrame([(0, 0.0, 2.0), (1, 2.0, 3.0)], "bin int, start double, end double")
    assert [r["count"] for r in compare.rebinned(old, new).orderBy("bin").collect()] == [12.0, 3.0]


def test_labels(spark):
    assert labels.label("fwhm_x") == "Full-width at half maximum X" and labels.label("summary_bg_mean") == "Summary Background Mean"
    assert labels.family("summary_bg_k", "bold") == "Signal Summaries" and labels.family("summary_bg_k", "T1w") == "Tissue Summaries" and labels.family("size_x", "T1w") == "Resolution"
    assert labels.unit("spacing_tr") == "mm" and labels.unit("fd_num") == "count" and labels.unit("fd_perc") == "percent" and labels.unit("cjv") is None
    assert labels.search_score("abc", "abd") == 0 and labels.search_score("fd mean", "fd") > labels.search_score("f xd", "fd")
    assert labels.search(spark, "bold", "fd_mean").first().field == "fd_mean" and labels.search(spark, "bold", " ").count() == 44
    assert labels.describe("spacing_x", "T1w").endswith("in mm.")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.recursive(st.none() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(), c, max_size=3), max_leaves=6), max_size=6), st.integers(1, 9))
def test_array_items(values, chunk):
    import io

    from scanlens.sources.dump import array_items

    for indent in (None, 1):
        text = io.StringIO(" " + json.dumps(values, indent=indent, ensure_ascii=False) + "\n")
        assert [json.loads(x) for x in array_items(text.read, chunk)] == values
