import hashlib
import io
import random
import struct

import pytest
import zstandard

from pagemill.llm import warc
from pagemill.llm.warc import archive_pages, page_of, parsed, read_archives, record_bytes, records_of, unresolved, write_archives
from pagemill.sources.folders import scratch_path


def sha(b):
    return hashlib.sha256(b).hexdigest()


def response(k, payload):
    return record_bytes("response", f"urn:page:{k}", f"https://h.example/{k}", "2024-01-01T00:00:00Z", payload, sha(payload))


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "<p>", "</p>"]) for _ in range(n)).encode()


def archive(records, dictionary=b"", packed=True):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    lead = (warc.dictionary_frame(dictionary) if packed else struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary) if dictionary else b""
    return lead, [zstandard.ZstdCompressor(dict_data=d).compress(r) for r in records]


@pytest.mark.parametrize("packed", [True, False])
def test_dictionary_of_the_leading_frame(packed):
    payloads = [words(k, 200 + k) for k in range(40)]
    records = [response(k, p) for k, p in enumerate(payloads)]
    dictionary = warc.made_dictionary(records)
    assert dictionary[:4] == warc.DICTIONARY
    lead, frames = archive(records, dictionary, packed)
    got = list(records_of(io.BytesIO(lead + b"".join(frames))))
    assert [r["payload"] for r in got] == payloads and not any(r["error"] for r in got)
    assert [r["offset"] for r in got] == [len(lead) + sum(map(len, frames[:k])) for k in range(40)]
    without = list(records_of(io.BytesIO(b"".join(frames))))
    assert all(r["error"] for r in without)  # the frames ask for their dictionary


def test_no_dictionary_and_other_skippable_frames():
    _, frames = archive([response(1, b"x" * 300_000), response(2, b"")])
    other = struct.pack("<II", 0x184D2A50, 5) + b"hello"
    got = list(records_of(io.BytesIO(frames[0] + other + frames[1])))
    assert [(r["payload_bytes"], r["payload_digest"], r["error"]) for r in got] == [(300_000, sha(b"x" * 300_000), None), (0, sha(b""), None)]
    assert list(records_of(io.BytesIO(b""))) == []


def test_bad_frames_lose_no_other_record():
    records = [response(k, words(k, 3000)) for k in range(6)]
    lead, frames = archive(records, warc.made_dictionary([response(k, words(k, 50)) for k in range(90)]))
    broken = frames[2][:40] + bytes(x ^ 0xFF for x in frames[2][40:80]) + frames[2][80:]
    got = list(records_of(io.BytesIO(lead + b"".join([*frames[:2], broken, *frames[3:]]))))
    assert [r["record_id"] for r in got if not r["error"]] == [f"urn:page:{k}" for k in (0, 1, 3, 4, 5)] and any(r["error"] for r in got)
    cut = list(records_of(io.BytesIO(lead + b"".join(frames)[:-9])))
    assert [bool(r["error"]) for r in cut] == [False] * 5 + [True] and cut[-1]["error"] == "the frame is cut off"
    assert "cut off" in next(records_of(io.BytesIO(lead[:30])))["error"]
    wrong = struct.pack("<II", warc.SKIPPABLE, 4) + b"nope"
    assert "no dictionary" in next(records_of(io.BytesIO(wrong + frames[0])))["error"]


def test_every_cut_and_changed_byte_is_noticed():
    record = response(7, b"some payload, some more")
    for k in range(len(record)):
        with pytest.raises(ValueError):
            parsed(record[:k])
    told = parsed(record)
    for k in range(record.index(b"HTTP/1.1"), len(record)):
        with pytest.raises(ValueError):
            parsed(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])
    assert told["payload"] == b"some payload, some more" and told["target_uri"] == "https://h.example/7"


@pytest.mark.parametrize(
    "old, new, error",
    [
        (b"WARC/1.1", b"WARC/9.9", "no WARC record"),
        (b"WARC-Date", b"WARC-Dat", "warc-date is missing"),
        (b"WARC-Date:", b"WARC Date:", "no header"),
        (b"WARC-Date:", b"WARC-Type:", "stands twice"),
        (b"\r\nContent-Length: ", b"\r\nContent-Length: x", "no number"),
        (b"HTTP/1.1 200 OK", b"HTTP/1.1 200 OKAY", "bytes, not"),
    ],
)
def test_what_is_wrong(old, new, error):
    with pytest.raises(ValueError, match=error):
        parsed(response(1, b"payload").replace(old, new, 1))


def test_headers_that_go_on_and_odd_addresses():
    record = record_bytes("response", "a b>", "https://h/\r\nX: y", "2024-01-01T00:00:00Z", b"p", sha(b"p"))
    assert parsed(record)["record_id"] == "a%20b%3E" and parsed(record)["target_uri"] == "https://h/%0D%0AX:%20y"
    folded = response(1, b"p").replace(b"https://h.example/1", b"https://h.example\r\n /1")
    assert parsed(folded)["target_uri"] == "https://h.example /1"
    assert parsed(record_bytes("response", "x", None, "d", b"", sha(b"")))["target_uri"] is None


def rows(df):
    return sorted(((r.page, r.record_type, r.payload_bytes, r.payload_digest, r.first, None if r.payload is None else bytes(r.payload), r.error) for r in df.where("record_type <> 'warcinfo' OR error IS NOT NULL").select(page_of(df.record_id).alias("page"), "record_type", "payload_bytes", "payload_digest", page_of(df.refers_to).alias("first"), "payload", "error").collect()), key=repr)


def test_pages_to_archives_and_back(spark):
    big, other = "a" * 100, "é" * 60
    pages = [(5, "https://h/5", big), (3, None, big), (9, "https://h/9", big), (3, "https://h/3", big), (1, "u", None), (2, "u", ""), (4, "u", "b" * 99), (6, "u", "b" * 99), (None, "u", other), (8, "u", other), (7, "u\n", "\n\r\n" * 40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = archive_pages(df)
    records = read_archives(archives)
    got = rows(records)
    want = []
    for page, _, html in pages:
        b = (html or "").encode()
        first = {big: 3, other: 8}.get(html)
        want.append([page, "response" if first in (None, page) else "revisit", len(b), sha(b), None if first in (None, page) else first, b, None])
    again = next(w for w in want if w[0] == 3)
    again[1], again[4] = "revisit", 3  # of equal rows one is the response
    want = sorted(((*w[:5], None if w[1] == "revisit" else w[5], None) for w in want), key=repr)
    assert got == want
    assert unresolved(records).count() == 0
    assert unresolved(records.where("record_id <> 'urn:page:8'")).collect()[0].refers_to == "urn:page:8"
    assert sum(r.records for r in archives.collect()) == len(pages)
    assert all(r.payload is None and (r.payload_bytes, r.payload_digest) for r in read_archives(archives, payloads=False).collect())
    assert read_archives(archive_pages(df.where("false"))).count() == 0


def test_archives_end_and_others_begin(spark):
    df = spark.range(3000).selectExpr("concat('urn:page:', id) AS record_id", "'response' AS record_type", "'u' AS target_uri", "CAST(NULL AS STRING) AS refers_to", "CAST(repeat(sha2(CAST(id AS STRING), 256), 20) AS BINARY) AS payload", "sha2(repeat(sha2(CAST(id AS STRING), 256), 20), 256) AS payload_digest").coalesce(2)
    archives = write_archives(df, scratch_path(spark, "archives"), archive_bytes=200_000)
    assert archives.count() > 2 and archives.agg({"records": "sum"}).first()[0] == 3000
    records = read_archives(archives)
    assert records.where("record_type = 'warcinfo'").count() == archives.count()
    assert [r.record_id for r in records.where("record_type = 'response'").select("record_id").distinct().orderBy("record_id").limit(2).collect()] == ["urn:page:0", "urn:page:1"]
    assert records.where("record_type = 'response' AND error IS NULL").count() == 3000
