"""Backfill, catch-up and details runs against an interface on this machine: pages and cursors in one commit."""

import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tideglass.sources import backfill, http
from tideglass.sources.tables import KeyedTable


class Interface:
    """Matches in pages of five, newest first; and one match by id."""

    def __init__(self, ids):
        self.ids, self.asked, self.broken = set(ids), [], set()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                url = urlparse(self.path)
                outer.asked.append(self.path)
                if url.path.startswith("/match/"):
                    wanted = int(url.path.split("/")[-1])
                    code = 404 if wanted not in outer.ids else 429 if wanted in outer.broken else 200
                    body = {"match_id": wanted, "full": True}
                else:
                    before = int(parse_qs(url.query).get("before", ["1000000"])[0])
                    code, body = 200, [{"match_id": i} for i in sorted((i for i in outer.ids if i < before), reverse=True)[:5]]
                self.send_response(code)
                self.send_header("Retry-After", "0")
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def interface(spark):
    spark.dataSource.register(http.JsonApi)
    made = Interface(range(1, 24))
    yield made
    made.server.shutdown()


def stored(table):
    return sorted(r.match_id for r in table.read().collect())


def run(table, interface, checkpoint):
    query = backfill.backfill(table, "a", interface.url, "before", f"file://{checkpoint}", interval="0")
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_backfill_then_catch_up(spark, tmp_path, interface):
    table = backfill.raw_table(spark, f"file://{tmp_path}/raw", buckets=4)
    with pytest.raises(ValueError, match="backfill first"):
        backfill.catch_up(table, "a", interface.url, "before")
    run_until(table, interface, tmp_path / "c", 1)
    assert stored(table) == list(range(1, 24)) and backfill.reach(table, "a") == (1, 23)
    interface.ids |= set(range(24, 40))
    interface.asked.clear()
    assert backfill.catch_up(table, "a", interface.url, "before", interval="0") == 16
    assert stored(table) == list(range(1, 40)) and backfill.reach(table, "a") == (1, 39)
    assert backfill.catch_up(table, "a", interface.url, "before", interval="0") == 0 and backfill.reach(table, "a") == (1, 39)


def run_until(table, interface, checkpoint, least):
    """Runs until the lower end is there; a stream of pages ends a run when it has caught up."""
    for _ in range(10):
        run(table, interface, checkpoint)
        if backfill.reach(table, "a")[0] == least:
            return
    raise AssertionError(backfill.reach(table, "a"))


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_kill_between_page_and_mark_repeats_and_loses_nothing(spark, tmp_path, interface, monkeypatch, when):
    """The driver dies before, or right after, a page is published; Spark has not noted the batch either way."""
    table = backfill.raw_table(spark, f"file://{tmp_path}/raw", buckets=4)
    publish, count = KeyedTable._publish, []

    def dying(self, new):
        count.append(1)
        if len(count) == 2:
            if when == "after":
                assert publish(self, new)
            raise RuntimeError("lost")
        return publish(self, new)

    monkeypatch.setattr(KeyedTable, "_publish", dying)
    with pytest.raises(Exception, match="lost"):
        for _ in range(5):
            run(table, interface, tmp_path / "c")
    at = (19, 23) if when == "before" else (14, 23)
    assert backfill.reach(table, "a") == at and stored(table) == list(range(at[0], 24))  # rows and cursors agree
    interface.ids |= {24, 25}  # the interface has grown meanwhile
    versions = table.snapshot().version
    run_until(table, interface, tmp_path / "c", 1)
    assert stored(table) == list(range(1, 24)) and table.snapshot().version > versions
    assert backfill.catch_up(table, "a", interface.url, "before", interval="0") == 2 and stored(table) == list(range(1, 26))


def test_a_lost_checkpoint_goes_on_at_the_stored_cursor(spark, tmp_path, interface, monkeypatch):
    table = backfill.raw_table(spark, f"file://{tmp_path}/raw", buckets=4)
    run_until(table, interface, tmp_path / "c", 1)
    interface.asked.clear()
    interface.ids.add(0)
    run_until(table, interface, tmp_path / "another", 0)
    assert stored(table) == list(range(24)) and all("before=" in q for q in interface.asked)


def test_details_are_stored_and_the_rest_is_named(spark, tmp_path, interface):
    table = backfill.raw_table(spark, f"file://{tmp_path}/raw", buckets=4)
    assert backfill.fetch_details(table, "a", [], interface.url) == {}
    assert backfill.fetch_details(table, "a", [3, 99, 5], interface.url + "/match/{id}", interval="0") == {"ok": 2, "missing": 1}
    assert stored(table) == [3, 5] and backfill.reach(table, "a") == (None, None)
    assert json.loads(table.read().first().payload)["full"]


def test_retry_after_is_kept_to():
    waits = []

    def refused(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 429, "slow", {"Retry-After": "30"}, None)

    with pytest.raises(RuntimeError, match="429"):
        http.fetch("http://x/", opener=refused, sleep=waits.append)
    assert waits == [30, 30, 30]
    assert http.asked_to_wait(urllib.error.HTTPError("x", 429, "", {"Retry-After": "9999"}, None)) == http.LONGEST_WAIT
    assert http.asked_to_wait(urllib.error.HTTPError("x", 429, "", {"Retry-After": "Wed"}, None)) == 0 == http.asked_to_wait(OSError())
