"""Web archives of Zstandard frames: a dictionary in a leading skippable frame, then one frame for each WARC record."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import scratch_path
from .exact_dedup import exact_dedup
from .tables import free_name, kept

#: The skippable frame that holds a dictionary, the beginnings of a frame and of a dictionary, and the profile of a revisit.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A dictionary is made of the first records of its archive, of so many bytes of each and in all at most, and has so many bytes at most.
SAMPLE_RECORD, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 10, 1 << 20, 64 << 10
#: An archive that has so many bytes is ended, and another one begun.
ARCHIVE_BYTES = 64 << 20
#: Bytes read at a time.
CHUNK = 1 << 16

MANIFEST = "archive string, records long, bytes long"
RECORD = (
    "archive string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload binary, payload_bytes long, payload_digest string, error string"
)


def _uri(text: str) -> str:
    """text without what would end a header's line or a record's id."""
    return re.sub(r"[\x00-\x20<>\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit: the response's HTTP header, which tells the payload's length, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_uri(record_id)}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _uri(uri))] if uri is not None else []
    head += [("WARC-Refers-To", f"<{_uri(refers_to or '')}>"), ("WARC-Profile", REVISIT)] if kind == "revisit" else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    block = b"software: pagemill\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def made_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of records; nothing where they are too few or too alike to make one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:SAMPLE_RECORD] for r in records], k=512, d=8).as_bytes() if len(records) > 7 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


class _Archive:
    """An archive that is being written. Its first records wait until there are enough to make the dictionary of."""

    def __init__(self, folder: str, date: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.waiting: list[bytes] = [_info(date)]
        self.held, self.records, self.bytes, self.out, self.pack = 0, 0, 0, None, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.pack:
            self._write(self.pack.compress(record))
            return
        self.waiting.append(record)
        self.held += min(len(record), SAMPLE_RECORD)
        if self.held >= SAMPLE_BYTES or sum(map(len, self.waiting)) >= ARCHIVE_BYTES:
            self._begin()

    def _begin(self) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        dictionary = made_dictionary(self.waiting)
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
        if dictionary:
            self._write(dictionary_frame(dictionary))
        for record in self.waiting:
            self._write(self.pack.compress(record))
        self.waiting = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def end(self) -> tuple[str, int, int]:
        if not self.pack:
            self._begin()
        self.out.close()
        return self.path, self.records, self.bytes


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records, bytes) of the archives that hold records (record_id, record_type, target_uri, refers_to, payload, payload_digest).

    Each task writes archives of its own under new names, into a folder that driver and executors share, and tells them as rows. Those rows are
    kept, and only what they name counts: files of tasks that failed or were run twice are named by none. A null payload counts as empty.
    """
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for record_id, kind, uri, refers_to, payload, digest in zip(*(batch.column(k) for k in range(len(names))), strict=True):
                archive = archive or _Archive(folder, date)
                archive.add(record_bytes(kind.as_py(), record_id.as_py(), uri.as_py(), date, payload.as_py() or b"", digest.as_py(), refers_to.as_py()))
                if archive.bytes >= archive_bytes:
                    done.append(archive.end())
                    archive = None
        if archive:
            done.append(archive.end())
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["archive", "records", "bytes"]).astype({"records": "int64", "bytes": "int64", "archive": "object"}), schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]), preserve_index=False)

    return kept(records.select(*names).mapInArrow(run, MANIFEST))


def archive_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", least_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """The archives (archive, records, bytes) of pages: of equal payloads of least_bytes or more, the one with the smallest id is a response and the
    others are revisits of it; smaller ones are all responses.

    A null payload is empty, a null id greater than any other; of equal rows one is the response. A record's id is urn:page: and the page's. Equal
    payloads are found by exact_dedup: rows that a Bloom filter tells to be unique aren't shuffled, and groups of any size are told apart without
    meeting in one task.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(uri_col).cast("string").alias("target_uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    small = F.octet_length("payload") < least_bytes
    record = lambda page: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")))
    told = exact_dedup(own.where(~small).withColumn("order", -F.col("page")), "order", "payload")
    large = told.select("page", "target_uri", "payload", F.col("text_sha256").alias("payload_digest"), F.when(~F.col("kept"), record(-F.col("keep_id"))).alias("refers_to"))
    every = large.unionByName(own.where(small).withColumns({"payload_digest": F.sha2("payload", 256), "refers_to": F.lit(None).cast("string")}))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    rows = every.select(record(F.col("page")).alias("record_id"), kind.alias("record_type"), "target_uri", "refers_to", F.col("payload").cast("binary").alias("payload"), "payload_digest")
    return write_archives(rows, folder or scratch_path(spark, "archives"))


def page_of(record_id: Column) -> Column:
    """The page's id in a record's id that archive_pages gave."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")


class _Reader:
    """Frames of an archive one by one, with the offset of each, reading CHUNK bytes at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.buffer, self.at = stream, b"", 0
        self.dictionary = self._dictionary()

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.stream.read(CHUNK)
            if not more:
                return False
            self.buffer += more
        return True

    def _skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def _dictionary(self) -> zstandard.ZstdCompressionDict | None:
        """Of the leading skippable frame, if there is one; it may be packed itself."""
        if not self._fill(8) or struct.unpack("<I", self.buffer[:4])[0] != SKIPPABLE:
            return None
        size = struct.unpack("<I", self.buffer[4:8])[0]
        if not self._fill(8 + size):
            raise ValueError("the dictionary's frame is cut off")
        data = self.buffer[8 : 8 + size]
        self._skip(8 + size)
        if data[:4] == FRAME:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if data[:4] != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        return zstandard.ZstdCompressionDict(data)

    def _to_next_frame(self) -> None:
        """Past the frame that begins here, to what looks like the next one's beginning, or to the end."""
        self._skip(min(4, len(self.buffer)))
        while (k := self.buffer.find(FRAME)) < 0:
            self._skip(max(0, len(self.buffer) - 3))
            if not self._fill(len(self.buffer) + 1):
                k = len(self.buffer)
                break
        self._skip(k)

    def frames(self) -> Iterator[tuple[int, bytes, str | None]]:
        """(offset, content, error). After a frame that can't be read, reading goes on at what looks like the next one's beginning."""
        reader = zstandard.ZstdDecompressor(dict_data=self.dictionary)
        while self._fill(1):
            begun, error = self.at, None
            self._fill(8)
            if len(self.buffer) >= 8 and 0x184D2A50 <= struct.unpack("<I", self.buffer[:4])[0] <= 0x184D2A5F:  # any other skippable frame
                size = 8 + struct.unpack("<I", self.buffer[4:8])[0]
                if not self._fill(size):
                    yield begun, b"", "a skippable frame is cut off"
                    return
                self._skip(size)
                continue
            raw, parts, one = [], [], reader.decompressobj()
            try:
                while not one.eof:
                    if not self._fill(1):
                        raise ValueError("the frame is cut off")
                    raw.append(self.buffer)
                    self.buffer = b""
                    parts.append(one.decompress(raw[-1]))
                self.buffer = one.unused_data
                self.at += sum(map(len, raw)) - len(self.buffer)
            except (zstandard.ZstdError, ValueError) as e:
                error, self.buffer = str(e), b"".join(raw)
                self._to_next_frame()
            yield begun, b"" if error else b"".join(parts), error


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # a line that goes on
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"no header: {line[:60]!r}")
        last = name.decode().lower()
        if last in out:
            raise ValueError(f"{last} stands twice")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _length(head: dict[str, str], name: str = "content-length") -> int:
    if not re.fullmatch(r"\d+", head.get(name, "")):
        raise ValueError(f"{name} is {'no number' if name in head else 'missing'}")
    return int(head[name])


def _digest_of(value: str | None, data: bytes, what: str) -> None:
    """Compares a digest of a kind that is known; others are left."""
    kind, _, told = (value or "").partition(":")
    if kind.lower() == "sha256" and told.lower() != hashlib.sha256(data).hexdigest():
        raise ValueError(f"the {what}'s digest differs")


def parsed(record: bytes) -> dict:
    """The fields of a record; ValueError tells what is wrong with it: its version, a header, its length, its end, a digest."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC record")
    fields = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    size = _length(fields)
    if len(rest) != size + 4:
        raise ValueError(f"the block has {max(0, len(rest) - 4)} bytes, not {size}")
    block, end = rest[:size], rest[size:]
    if end != b"\r\n\r\n":
        raise ValueError("the record's end is missing")
    _digest_of(fields.get("warc-block-digest"), block, "block")
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    out = {"record_type": fields["warc-type"], "record_id": bare("warc-record-id"), "target_uri": bare("warc-target-uri"), "date": fields["warc-date"], "refers_to": bare("warc-refers-to")}
    payload, told = block, None
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        answer = _headers(http.split(b"\r\n")[1:])
        told = _length(answer) if "content-length" in answer else None
    if out["record_type"] == "revisit":
        kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
        return out | {"payload": None, "payload_bytes": told, "payload_digest": digest.lower() if kind.lower() == "sha256" else None}
    if told is not None and told != len(payload):
        raise ValueError(f"the payload has {len(payload)} bytes, not {told}")
    _digest_of(fields.get("warc-payload-digest"), payload, "payload")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def records_of(stream) -> Iterator[dict]:
    """The records of an archive; what can't be read is one with an error."""
    empty = dict.fromkeys(("record_type", "record_id", "target_uri", "date", "refers_to", "payload", "payload_bytes", "payload_digest", "error"))
    try:
        frames = _Reader(stream)
    except (ValueError, zstandard.ZstdError) as e:
        yield empty | {"offset": 0, "error": str(e)}
        return
    for offset, content, error in frames.frames():
        try:
            if error:
                raise ValueError(error)
            yield empty | {"offset": offset} | parsed(content)
        except ValueError as e:
            yield empty | {"offset": offset, "error": str(e)}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(archive, offset, record_type, record_id, target_uri, date, refers_to, payload, payload_bytes, payload_digest, error) of the records of archives
    (archive: a path or address that every executor reaches); without payloads, payload is null.

    The dictionary comes from the archive's leading skippable frame, and each frame after it is one record. A record's version, headers, lengths, end
    and digests (sha256) are checked; one that fails is a row with an error, and reading goes on with the next frame. payload_bytes and payload_digest
    are of the full payload: of a revisit, which doesn't hold it, what its headers tell. An archive without a dictionary is read as well, and an
    empty one has no row. Archives are dealt over tasks, and a task holds one record at a time, whatever the archive's size.
    """
    count = free_name(archives, "n")
    n = archives.agg(F.count("*").alias(count)).first()[count]  # one number
    tasks = max(1, min(n, 32 * archives.sparkSession.sparkContext.defaultParallelism))
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = pa.schema([(name, pa.binary() if name == "payload" else pa.int64() if name in ("offset", "payload_bytes") else pa.string()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place) as stream:
                    for record in records_of(stream):
                        rows.append({"archive": path} | record | ({} if payloads else {"payload": None}))
                        held += len(rows[-1]["payload"] or b"")
                        if held >= 8 << 20 or len(rows) >= 2000:
                            yield told(rows)
                            rows, held = [], 0
                if rows:
                    yield told(rows)

    return archives.select("archive").repartition(tasks).mapInArrow(run, RECORD)


def unresolved(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, revisits): what revisits refer to that isn't among the responses, or has another digest."""
    asked = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("revisits"))
    there = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest")
    return asked.join(there, ["refers_to", "payload_digest"], "left_anti")
