"""Fetching: a URL once, hosts at their pace, retries; against a local server and a clock of our own."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError

import pytest

from quarryspark.sources import fetching
from quarryspark.sources.files import http_get


@pytest.fixture
def server():
    seen, times = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen[self.path] += 1
            times.append(time.monotonic())
            code = 503 if self.path.startswith("/flaky") and seen[self.path] < 3 else 404 if self.path == "/gone" else 302 if self.path == "/moved" else 200
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "/there")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            if code == 200:
                self.wfile.write(f"<title>é {self.path}</title>".encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen, times
    s.shutdown()


def test_pages_of_a_server(spark, server):
    root, seen, times = server
    urls = [f"{root}{p}" for p in ("/a", "/a", "/b", "/flaky", "/gone", "/moved")] + [None, "http://127.0.0.1:1/closed", "no url"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string").repartition(3)
    pages = fetching.fetch_pages(frame, http_get, retries=2, pace=0.05)
    got = {r.url: r for r in pages.collect()}
    assert pages.count() == len(got) == len({u for u in urls if u})
    assert got[f"{root}/a"].html == "<title>é /a</title>" and got[f"{root}/moved"].html == "<title>é /there</title>"
    assert (got[f"{root}/flaky"].attempts, got[f"{root}/flaky"].error) == (3, None)
    assert got[f"{root}/gone"].error.startswith("HTTPError") and got[f"{root}/gone"].attempts == 1
    assert got["http://127.0.0.1:1/closed"].html is None and got["http://127.0.0.1:1/closed"].attempts == 3 and got["no url"].error
    assert seen["/a"] == 1 and seen["/gone"] == 1  # neither a second plan nor a second task asks again
    gaps = [b - a for a, b in zip(sorted(times), sorted(times)[1:], strict=False)]
    assert sum(g < 0.04 for g in gaps) <= 1  # but for the redirect


def run(urls, fetch, **settings):
    now, asked = [0.0], []

    def sleep(s):
        now[0] += s

    def get(url):
        asked.append((now[0], url))
        return fetch(url)

    return list(fetching.fetch_lane(iter(urls), get, clock=lambda: now[0], sleep=sleep, **settings)), asked, now[0]


def test_hosts_keep_their_pace_and_share_the_time():
    urls = [f"http://h{k % 4}/{k}" for k in range(20)]
    rows, asked, took = run(urls, str.upper, pace=1.0)
    assert sorted(r[0] for r in rows) == sorted(urls) and took == pytest.approx(4.0)  # five a host, all hosts at once
    for h in range(4):
        times = [t for t, u in asked if u.startswith(f"http://h{h}/")]
        assert all(b - a >= 1.0 for a, b in zip(times, times[1:], strict=False))


def test_backing_off_and_giving_up(monkeypatch):
    monkeypatch.setattr(fetching, "GIVE_UP", 4)

    def fails(url):
        raise TimeoutError("no answer") if "dead" in url else HTTPError(url, 400, "bad", None, None)

    rows, asked, _ = run([f"http://dead/{k}" for k in range(9)] + ["http://bad/1"], fails, pace=1.0, retries=2)
    errors = {r[0]: (r[2], r[3]) for r in rows}
    assert len(rows) == 10 and errors["http://bad/1"][1] == 1
    dead = [t for t, u in asked if "dead" in u]
    assert len(dead) == 4 and [b - a for a, b in zip(dead, dead[1:], strict=False)] == [2.0, 4.0, 1.0]
    assert sum("HostGivenUp" in e for e, _ in errors.values()) == 7


def test_no_urls(spark):
    assert fetching.fetch_pages(spark.createDataFrame([(None,)], "url string"), str.upper).count() == 0
