import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagemill.sources.fetch import fetch_files


@pytest.fixture
def server():
    seen = {"connections": 0, "paths": []}

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            seen["connections"] += 1
            super().setup()

        def log_message(self, *a):
            pass

        def answer(self, status, body=b"", **headers):
            self.send_response(status)
            for k, v in {"Content-Length": str(len(body)), **{k.replace("_", "-"): v for k, v in headers.items()}}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            seen["paths"].append(self.path)
            name = self.path.partition("?")[0].strip("/")
            if name.startswith("file"):
                self.answer(200, f"{self.path}".encode())
            elif name == "moved":
                self.answer(302, b"gone", Location="/file-moved?x=1")
            elif name == "loop":
                self.answer(301, Location="/loop")
            elif name == "large":
                self.answer(200, b"x" * 5000)
            elif name == "endless":  # no length is declared
                self.send_response(200)
                self.send_header("Connection", "close")
                self.end_headers()
                try:
                    for _ in range(10_000):
                        self.wfile.write(b"y" * 1000)
                except OSError:
                    pass
                self.close_connection = True
            elif name == "slow":
                self.send_response(200)
                self.send_header("Content-Length", "3")
                self.end_headers()
                self.wfile.write(b"a")
                self.wfile.flush()
                time.sleep(4)
            elif name == "drip":
                self.send_response(200)
                self.send_header("Content-Length", "100")
                self.end_headers()
                try:
                    for _ in range(100):
                        self.wfile.write(b"a")
                        self.wfile.flush()
                        time.sleep(0.1)
                except OSError:
                    pass
            else:
                self.answer(int(name), b"no")

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_files_and_errors(spark, server):
    root, _ = server
    names = ["file1", "file2?q=é".replace("é", "%C3%A9"), "moved", "loop", "large", "endless", "slow", "drip", "404", "403", "500", "204"]
    rows = [(n, f"{root}/{n}", "x") for n in names] + [("refused", "http://127.0.0.1:9/x", "x"), ("null", None, "x"), ("ftp", "ftp://h/x", "x"), ("odd", "no url", "x")]
    df = spark.createDataFrame(rows, "file_id string, url string, Status string")
    began = time.monotonic()
    got = {r.file_id: r for r in fetch_files(df, max_bytes=4000, seconds=1.5, tasks=4).collect()}
    assert time.monotonic() - began < 30 and len(got) == len(rows)
    assert bytes(got["file1"].content) == b"/file1" and got["file1"].content_length == 6 and got["file1"].error is None and got["file1"].status == 200
    assert bytes(got["moved"].content) == b"/file-moved?x=1" and got["204"].error is None and bytes(got["204"].content) == b""
    assert got["large"].code == got["endless"].code == "FILE_LIMIT_EXCEEDED" and got["large"].error == "Arquivo excede o limite configurado de 4000 bytes." and got["large"].content is None
    assert got["404"].error == "Arquivo não encontrado no bucket. Verifique se o arquivo existe." and got["403"].error == "Erro HTTP 403: Forbidden"
    assert got["500"].error == "Failed to fetch file: Request failed with status code 500"
    assert got["slow"].error == got["drip"].error == "Failed to fetch file: timeout of 1500ms exceeded"
    assert got["loop"].error == "Failed to fetch file: Maximum number of redirects exceeded"
    assert all(got[k].error.startswith("Failed to fetch file: ") and got[k].content is None for k in ("refused", "null", "ftp", "odd"))


def test_connections_are_kept(spark, server):
    root, seen = server
    df = spark.createDataFrame([(k, f"{root}/file{k}") for k in range(60)], "k long, url string")
    got = fetch_files(df, tasks=3).collect()
    assert sorted(bytes(r.content) for r in got) == sorted(f"/file{k}".encode() for k in range(60))
    assert len(seen["paths"]) == 60 and seen["connections"] <= 4


def test_no_limit(spark, server):
    root, _ = server
    [r] = fetch_files(spark.createDataFrame([(f"{root}/large",)], "url string"), max_bytes=0).collect()
    assert len(r.content) == 5000 and r.error is None and r.code is None
    assert fetch_files(spark.createDataFrame([], "url string")).count() == 0
