"""Fetching from a server on this machine."""

import io
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from deckweave.operators import html
from deckweave.sources import fetch


@pytest.fixture(scope="module")
def server():
    seen = {}

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            code = 404 if self.path == "/none" else 503 if self.path == "/busy" and seen[self.path] < 2 else 302 if self.path == "/away" else 200
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "/login")
            self.end_headers()
            self.wfile.write(b'<a href="/x">caf\xc3\xa9</a>')

        def log_message(self, *args):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_fetch(spark, server):
    asked = spark.createDataFrame([(f"{server}/a",), (f"{server}/a",), (f"{server}/none",), (f"{server}/busy",), (f"{server}/away",), ("nonsense",), (None,)], "url string")
    got = {r["url"].replace(server, ""): r for r in fetch.fetch(asked, seconds=5).collect()}
    assert {k: (r["status"], r["error"] is None, r["signed_out"]) for k, r in got.items()} == {"/a": (200, True, False), "/none": (404, False, False), "/busy": (200, True, False), "/away": (200, True, True), "nonsense": (None, False, False)}
    assert bytes(got["/a"]["body"]).decode().endswith("café</a>")


def test_dependent_fetch(spark, server):
    asked = spark.createDataFrame([(f"{server}/a",), (f"{server}/none",)], "url string")
    pages = fetch.text(fetch.fetch(asked, seconds=5))
    assert {(r["url"].rpartition("/")[2], r["href"], r["failed"]) for r in html.links(pages).collect()} == {("a", "/x", False), ("none", None, True)}
    assert [r["url"] for r in fetch.missing(asked, pages.where("NOT failed")).collect()] == [f"{server}/none"]


def test_pauses(monkeypatch):
    waits, calls = [], []

    def lost(*args, **kwargs):
        calls.append(1)
        raise ConnectionResetError("reset")

    monkeypatch.setattr("urllib.request.urlopen", lost)
    assert fetch.read_url("http://x.example/", {}, 2, 3, waits.append)["error"] == "reset" and waits == [1, 2] and len(calls) == 3


def test_sign_in_mark_anywhere_in_the_body(monkeypatch):
    class Page(io.BytesIO):
        url, status = "http://x.example/", 200

    monkeypatch.setattr("urllib.request.urlopen", lambda *args, **kwargs: Page(b" " * 300_000 + b'<input NAME="loginfmt">'))
    assert fetch.read_url("http://x.example/", {}, 2, 1)["signed_out"]
