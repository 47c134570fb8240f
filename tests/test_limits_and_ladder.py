import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.config import OcrKnobs
from pagemill.operators.messages import TIMEOUT_SECONDS, timeout_error
from pagemill.operators.ocr import best_attempt, chunk_errors, rotation_choice, tsv_text, tsv_words
from pagemill.sources import engines, extract
from pagemill.sources.deadline import Failed, Guard, Overdue
from pagemill.sources.ladder import Reading, Rung, climb, preparation, reading_of


def sleepy(x):
    while x == "hang":
        time.sleep(1)
    if x == "die":
        os._exit(7)
    if x == "bad":
        raise ValueError("bad input")
    return x.upper()


def test_calls_under_a_limit():
    with Guard({"f": sleepy}) as guard:
        assert guard.call("f", "a", seconds=20) == "A"
        first = guard.child.pid
        assert guard.call("f", "b", seconds=20) == "B" and guard.child.pid == first  # one child for all
        with pytest.raises(Failed, match="bad input"):
            guard.call("f", "bad", seconds=20)
        assert guard.child.pid == first
        began = time.monotonic()
        with pytest.raises(Overdue):
            guard.call("f", "hang", seconds=0.3)
        assert time.monotonic() - began < 5
        assert guard.call("f", "c", seconds=20) == "C"
        with pytest.raises(Failed, match="ended with 7"):
            guard.call("f", "die", seconds=20)
        assert guard.call("f", "d", seconds=20) == "D"
        pid = guard.child.pid
        assert guard.call("f", "e") == "E" and guard.child.pid == pid  # without a limit, here
    with pytest.raises(ProcessLookupError):
        os.kill(first, 0)
    with pytest.raises(ProcessLookupError):
        os.kill(pid, 0)


def test_a_child_without_a_parent_ends_itself():
    guard = Guard({"f": time.sleep})
    guard._start()
    pid = guard.child.pid
    guard.pipe.send(("f", (600,), 0.1))
    for _ in range(100):
        guard.child.join(0.1)
        if guard.child.exitcode is not None:
            break
    assert guard.child.exitcode == -14 and pid


def test_one_hanging_file_leaves_the_others(spark):
    def engine(content):
        while content == b"hang":
            time.sleep(1)
        if content == b"die":
            os._exit(3)
        return content.decode()

    rows = [(f"f{k}", "image", bytearray(b"hang" if k in (3, 7) else b"die" if k == 5 else b"text")) for k in range(10)]
    files = spark.createDataFrame(rows, "file_id string, extractor string, content binary").coalesce(1)
    began = time.monotonic()
    got = {r.file_id: r for r in extract.extract_texts(files, extract.registry(image=engine), limits={"image": 0.5}).collect()}
    assert time.monotonic() - began < 60
    assert {k for k, r in got.items() if r.overdue} == {"f3", "f7"}
    assert got["f3"].error == "O processamento deste arquivo IMAGE excedeu o tempo limite de 0.5 segundos." and got["f3"].value is None
    assert got["f5"].error == "the process of image ended with 3"
    assert [got[f"f{k}"].value for k in (0, 1, 2, 4, 6, 8, 9)] == ["text"] * 7
    told = spark.createDataFrame([(k,) for k in TIMEOUT_SECONDS], "k string").select(timeout_error(F.col("k")).alias("e")).collect()
    assert told[0].e == "O processamento deste arquivo TXT excedeu o tempo limite de 10 segundos."


GOOD, POOR = Reading("x" * 400, 90.0, 50), Reading("x" * 100, 60.0, 20)


def recorded(readings):
    seen = []

    def attempt(rung):
        seen.append((rung.label, rung.mode, rung.angle))
        r = readings[len(seen) - 1]
        if isinstance(r, Exception):
            raise r
        return r

    return attempt, seen


def test_the_first_good_attempt_is_the_last():
    attempt, seen = recorded([GOOD, POOR, POOR])
    found = climb(attempt)
    assert found.reading is GOOD and found.made == 1 and seen == [("orig", 4, 0)]
    attempt, seen = recorded([POOR, GOOD, POOR, POOR])
    assert climb(attempt, knobs=OcrKnobs(max_attempts=4)).reading is GOOD and seen == [("orig", 4, 0), ("prep", 4, 0)]
    attempt, seen = recorded([POOR] * 4)
    assert climb(attempt, knobs=OcrKnobs(max_attempts=4)).rung == Rung("orig", 4) and seen == [("orig", 4, 0), ("prep", 4, 0), ("orig", 6, 0), ("prep_thr", 6, 0)]
    attempt, seen = recorded([POOR] * 4)
    climb(attempt, lambda rung: rung.label == "orig")
    assert seen == [("orig", 4, 0), ("orig", 6, 0)]  # what can't be prepared is left out


def test_failed_attempts_are_skipped():
    attempt, seen = recorded([POOR, ValueError("no"), GOOD])
    found = climb(attempt, knobs=OcrKnobs(max_attempts=3))
    assert found.reading is GOOD and (found.made, found.failed) == (3, 1)
    attempt, seen = recorded([ValueError("no"), GOOD])
    found = climb(attempt)
    assert found.reading is None and found.made == 1  # nothing is queued by what wasn't read


def test_turns_only_on_weak_evidence():
    weak = Reading("x" * 20, 30.0, 3)
    knobs = OcrKnobs(max_attempts=1, rotate=True, rotate_max_attempts=2)
    attempt, seen = recorded([weak, POOR, GOOD])
    assert climb(attempt, knobs=knobs, angles=[90, 270]).rung.angle == 270 and len(seen) == 3
    attempt, seen = recorded([POOR])
    assert climb(attempt, knobs=knobs, angles=[90, 270]).made == 1
    attempt, seen = recorded([ValueError(), ValueError(), POOR])
    assert climb(attempt, knobs=knobs, angles=[90, 270]).rung == Rung("rotated", 4, 270)


cells = st.tuples(st.floats(0, 100), st.integers(0, 80), st.integers(0, 900))


def test_ladder_is_what_the_operators_choose(spark):
    import random

    r = random.Random(1)
    pages = {p: [(round(r.uniform(20, 100), 2), r.randrange(80), r.randrange(900)) for _ in range(r.randrange(1, 5))] for p in range(200)}
    turns = {p: [(round(r.uniform(20, 100), 2), r.randrange(80), r.randrange(900)) for _ in range(2)] for p in pages}
    knobs = OcrKnobs(max_attempts=4, rotate=True, rotate_max_attempts=2)
    attempts = spark.createDataFrame([(p, k, *a) for p, x in pages.items() for k, a in enumerate(x, 1)], "page long, attempt int, confidence double, words long, chars long")
    rotated = spark.createDataFrame([(p, (90, 270)[k], *a) for p, x in turns.items() for k, a in enumerate(x)], "page long, angle int, confidence double, words long, chars long")
    best = best_attempt(attempts, ["page"], knobs)
    want = {x.page: (x.attempt, round(x.score, 9)) for x in best.collect()}
    chosen = {x.page: (x.angle, round(x.score, 9)) for x in rotation_choice(best, rotated, ["page"], [90, 270], knobs).collect()}
    reading = lambda a: Reading("x" * a[2], a[0], a[1])
    for p, x in pages.items():
        rungs = [Rung("orig", 4), Rung("prep", 4), Rung("orig", 6), Rung("prep_thr", 6)][: len(x)]
        own = dict(zip(rungs, map(reading, x), strict=True)) | {Rung("rotated", 4, angle): reading(a) for angle, a in zip((90, 270), turns[p], strict=True)}
        plain = climb(own.__getitem__, own.__contains__, OcrKnobs(max_attempts=4))
        assert (rungs.index(plain.rung) + 1, round(plain.score, 9)) == want[p]
        found = climb(own.__getitem__, own.__contains__, knobs, [90, 270])
        assert (found.rung.angle, round(found.score, 9)) == chosen[p]


line = st.lists(st.sampled_from(["5", "4", "1", "2", " ", "w", "ab", "-1", "90.5", "1e1x", "nan", "", "é "]), min_size=10, max_size=14).map("\t".join)


def test_tables_are_read_as_the_operators_read_them(spark):
    import random

    r = random.Random(2)
    cell = ["5"] * 4 + ["1", "2", " ", "w", "ab", "-1", "90.5", "1e1x", "nan", "", "é "]
    tables = ["\n".join("\t".join([r.choice(["5", "5", "4"])] + [r.choice(cell) for _ in range(r.randrange(9, 13))]) for _ in range(r.randrange(0, 9))) for _ in range(150)]
    rows = spark.createDataFrame([(t, k, x) for t, table in enumerate(tables) for k, x in enumerate(table.split("\n"))], "t long, k long, line string")
    want = {x.t: (x.text, round(x.mean_confidence, 9), x.word_count) for x in tsv_text(tsv_words(rows), ["t"], "k").collect()}
    for t, table in enumerate(tables):
        found = reading_of(table)
        assert (found.text, round(found.confidence, 9), found.words) == want.get(t, ("", 0.0, 0))


WORD = "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t{}\t{}"


@pytest.fixture
def raster():
    def pages(file, first, last):
        """A file of records of ten bytes, each a page; reads no more than it is asked for."""
        file.seek((first - 1) * 10)
        return [file.read(10) for _ in range(first, last + 1)]

    return pages


def test_chunks_are_read_by_path_and_range(spark, tmp_path, raster):
    for name, n in (("a", 6), ("b", 3)):
        (tmp_path / name).write_bytes(b"".join(f"{name}-page{k:04d}"[:10].encode().ljust(10) for k in range(1, n + 1)))
    chunks = [("a", f"file://{tmp_path}/a", k, k + 1) for k in (1, 3, 5)] + [("b", str(tmp_path / "b"), 1, 3), ("c", f"file://{tmp_path}/none", 1, 2)]
    df = spark.createDataFrame(chunks, "file_id string, path string, first long, last long")

    word = WORD

    def recogniser(image, rung):
        return "head\n" + word.format(60 if rung.label == "orig" else 95, image.decode().strip() + ("" if rung.label == "orig" else "*"))

    told = engines.recognise_pages(df, raster, recogniser, prepare=lambda image, rung: image)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(file_id" in plan and "content" not in plan
    got = {(r.file_id, r.page_number): r for r in told.collect()}
    assert got["a", 1].text == "a-page0001"[:10] + "*" and (got["a", 1].rung, got["a", 1].attempts) == ("prep", 2) and len([k for k in got if k[0] == "a"]) == 6
    assert [k for k in got if k[0] == "c"] == [("c", None)] and "none" in got["c", None].error
    spread = engines.recognise_pages(spark.createDataFrame([("a", "p", k, k) for k in range(1, 41)], df.schema), raster, recogniser, tasks=4)
    assert len({r.p for r in spread.select(F.spark_partition_id().alias("p")).collect()}) > 1  # chunks of one file are in several tasks
    none = engines.recognise_pages(df, raster, lambda image, rung: "")
    assert {(r.file_id, r.first, r.page_number, r.text) for r in none.where("error IS NULL").collect()} == {(*[c[k] for k in (0, 2)], None, None) for c in chunks if c[0] != "c"}


def test_attempts_and_chunks_that_fail(spark, tmp_path, raster):
    word = WORD
    (tmp_path / "a").write_bytes(b"x" * 60)
    df = spark.createDataFrame([("a", f"file://{tmp_path}/a", 1, 2), ("a", f"file://{tmp_path}/a", 3, 4), ("b", f"file://{tmp_path}/a", 1, 1)], "file_id string, path string, first long, last long")

    def second_fails(image, rung):
        if rung.label != "orig":
            raise RuntimeError("no second look")
        return word.format(50, "word")

    told = engines.recognise_pages(df, raster, second_fails, prepare=lambda image, rung: image)
    assert {(r.text, r.attempts, r.failed, r.error) for r in told.collect()} == {("word", 2, 1, None)}

    def hangs(file, first, last):
        while first == 3:
            time.sleep(1)
        return raster(file, first, last)

    rows = engines.recognise_pages(df, hangs, second_fails, seconds=1.2).collect()
    assert {(r.file_id, r.first, r.error) for r in rows} == {("a", 1, None), ("a", 3, "OCR processing timed out after 0.02 minutes"), ("b", 1, None)}
    outcomes = spark.createDataFrame([(r.file_id, r.first, r.error) for r in rows], "file_id string, first long, error string")
    assert {tuple(r) for r in chunk_errors(outcomes).collect()} == {("a", 2, 1, "Erro no processamento OCR: OCR processing timed out after 0.02 minutes"), ("b", 1, 0, None)}


def test_text_and_counts_have_limits_of_their_own(spark):
    def late(content, kind):
        while kind in content:
            time.sleep(1)
        return content

    text = lambda c: late(c, b"slow text").decode().split("|")
    images = lambda c: {1: len(late(c, b"slow images"))}
    tables = lambda c: {2: 1 // (b"bad tables" not in c)}
    names = ["a|b", "slow text", "slow images|x", "bad tables|y", ""]
    files = spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "file_id string, content binary").coalesce(1)
    rows = [tuple(r) for r in engines.native_pages(files, text, images, tables, text_seconds=0.7, metadata_seconds=0.7).collect()]
    assert sorted(r for r in rows if r[6] is None) == sorted(
        [("a|b", 1, "a", 3, 0, 2, None), ("a|b", 2, "b", 0, 1, 2, None), ("slow images|x", 1, "slow images", 0, 0, 2, None), ("slow images|x", 2, "x", 0, 1, 2, None), ("bad tables|y", 1, "bad tables", 12, 0, 2, None), ("bad tables|y", 2, "y", 0, 0, 2, None), ("", 1, "", 0, 0, 1, None)]
    )
    assert [r for r in rows if r[6]] == [("slow text", None, None, None, None, None, "Erro ao extrair texto do PDF: native PDF text extraction exceeded timeout of 700ms")]
    probes = engines.probe_files(files, lambda c: (True, len(late(c, b"slow images"))), seconds=0.7)
    assert {r.file_id: (r.valid, r.page_count) for r in probes.collect()} == {"a|b": (True, 3), "slow text": (True, 9), "slow images|x": (False, 0), "bad tables|y": (True, 12), "": (True, 0)}


def test_how_images_are_prepared():
    grey = (("colorspace", "Gray"), ("alpha", "off"), ("deskew", "40%"), ("normalize", ""))
    assert preparation(Rung("orig", 4)) == () and preparation(Rung("rotated", 4, 90)) == (("rotate", "90"),)
    assert preparation(Rung("prep", 4)) == grey
    assert preparation(Rung("prep", 4), OcrKnobs(scale=150)) == (*grey, ("filter", "Lanczos"), ("resize", "150%"))
    ways = {"": ("threshold", "55%"), "  -lat geometry": ("lat", "20x20+10%"), " -adaptive-threshold g\n -lat g": ("adaptive-threshold", "35x35+10%"), "-later": ("threshold", "55%")}
    for tools, way in ways.items():
        assert preparation(Rung("prep_thr", 6), tools=tools) == (*grey, way)
