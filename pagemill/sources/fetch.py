"""Files fetched over HTTP by the tasks that need them."""

from __future__ import annotations

import http.client
import time
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..operators.messages import download_error

#: Seconds that a file may take, redirects that are followed, and bytes read at a time.
SECONDS, REDIRECTS, PIECE = 60.0, 5, 1 << 16
COLUMNS = "status int, status_text string, failure string, content binary, content_length long, above boolean"


class _Client:
    """Connections of a task, one for each server, kept open from file to file."""

    def __init__(self, max_bytes: int, seconds: float):
        self.max_bytes, self.seconds = max_bytes, seconds
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def _ask(self, scheme: str, host: str, target: str, until: float) -> http.client.HTTPResponse:
        kind = {"http": http.client.HTTPConnection, "https": http.client.HTTPSConnection}.get(scheme)
        if kind is None or not host:
            raise ValueError(f"Unsupported protocol {scheme}:")
        for again in (False, True):  # a server may have closed a connection meanwhile
            fresh = (scheme, host) not in self.open
            connection = self.open.setdefault((scheme, host), kind(host, timeout=self.seconds))
            connection.timeout = max(0.001, until - time.monotonic())
            if connection.sock is not None:
                connection.sock.settimeout(connection.timeout)
            try:
                connection.request("GET", target, headers={"Accept": "*/*", "Connection": "keep-alive"})
                return connection.getresponse()
            except (http.client.RemoteDisconnected, ConnectionError):
                self.close(scheme, host)
                if fresh or again:
                    raise
        raise AssertionError

    def close(self, scheme: str, host: str) -> None:
        if found := self.open.pop((scheme, host), None):
            found.close()

    def get(self, url: str) -> tuple:
        """(status, status text, failure, content, declared or read bytes, whether that is above the limit)."""
        until = time.monotonic() + self.seconds
        parts = urlsplit(url)
        try:
            for _ in range(REDIRECTS + 1):
                target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
                answer = self._ask(parts.scheme, parts.netloc.rpartition("@")[2], target, until)
                if answer.status not in (301, 302, 303, 307, 308) or not answer.headers.get("Location"):
                    break
                self._read(answer, parts, until)
                parts = urlsplit(urljoin(parts.geturl(), answer.headers["Location"]))
            else:
                return None, None, "Maximum number of redirects exceeded", None, None, False
            declared = answer.headers.get("Content-Length", "")
            size = int(declared) if declared.isdigit() else None
            if answer.status < 400 and self.max_bytes > 0 and size is not None and size > self.max_bytes:
                self.close(parts.scheme, parts.netloc.rpartition("@")[2])  # what follows isn't read
                return answer.status, answer.reason, None, None, size, True
            content = self._read(answer, parts, until)
            if content is None:
                return answer.status, answer.reason, None, None, size, True
            return answer.status, answer.reason, None, content if answer.status < 400 else None, len(content) if size is None else size, False
        except Exception as e:  # of the network: the row has it, and others go on
            self.close(parts.scheme, parts.netloc.rpartition("@")[2])
            late = isinstance(e, TimeoutError)
            return None, None, f"timeout of {self.seconds * 1000:.0f}ms exceeded" if late else str(e) or type(e).__name__, None, None, False

    def _read(self, answer: http.client.HTTPResponse, parts, until: float) -> bytes | None:
        """The whole content, piece by piece while there is time; None, unread beyond, if it grows above the limit."""
        pieces, n = [], 0
        while piece := answer.read1(PIECE):
            pieces.append(piece)
            n += len(piece)
            if self.max_bytes > 0 and n > self.max_bytes:
                self.close(parts.scheme, parts.netloc.rpartition("@")[2])
                return None
            if time.monotonic() > until:
                raise TimeoutError
        answer.close()
        return b"".join(pieces)


def size_limit_error(above: Column, most: int) -> Column:
    return F.when(above, f"Arquivo excede o limite configurado de {most} bytes.")


def fetch_files(files: DataFrame, max_bytes: int = Limits.max_file_bytes, seconds: float = SECONDS, tasks: int | None = None) -> DataFrame:
    """files (url and more) with status, content, content_length, code and error.

    A task keeps a connection to each server, follows redirects, and gives a file so many seconds in all; a file above max_bytes (0: no limit) isn't read beyond it, be
    it by what the server declares or by what comes. What fails is a row with the error of download_error, and fails no other. A null URL is one
    that can't be fetched. Files are dealt over tasks evenly, which bounds the connections to a server; content comes in rows as it is read, a few at a time.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    own = files.select(*[c for c in files.columns if c.lower() not in (*names, "code", "error")])
    kinds = (pa.int32(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = _Client(max_bytes, seconds)
        for batch in batches:
            urls = batch.column("url").to_pylist()
            rows, begun, held = [], 0, 0
            for k, url in enumerate(urls):
                rows.append(client.get(url) if url is not None else (None, None, "Invalid URL", None, None, False))
                held += len(rows[-1][3] or b"")
                if held >= 16 << 20 or k + 1 == len(urls):
                    told = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(begun, len(rows)).columns, *told], names=[*batch.schema.names, *names])
                    begun, rows, held = k + 1, [], 0
        for connection in client.open.values():
            connection.close()

    dealt = own.repartition(tasks or own.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + [COLUMNS])
    told = dealt.mapInArrow(run, schema)
    error = F.coalesce(size_limit_error(F.col("above"), max_bytes), download_error(F.col("status"), F.col("status_text"), F.col("failure")))
    return told.withColumns({"code": F.when(F.col("above"), "FILE_LIMIT_EXCEEDED"), "error": error}).drop("failure", "above", "status_text")
