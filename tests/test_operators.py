from pyspark.sql import functions as F

from pagemill.config import Limits, OcrKnobs, env_bool, env_float, env_int
from pagemill.functions.ocr_score import pages_in_probe, rotation_angles, version_in_probe
from pagemill.operators import jobs as J
from pagemill.operators import messages as M
from pagemill.operators import ocr as O
from pagemill.operators import pages as P
from pagemill.operators import sheets as S


def chunks(spark, pages):
    df = spark.createDataFrame([("f", p) for p in pages], "file_id string, page_number int")
    return sorted((r.first, r.last) for r in P.selected_chunks(df).collect())


def test_selected_chunks(spark):
    assert chunks(spark, [9, 2, 4, 3, 9]) == [(2, 3), (4, 4), (9, 9)]
    assert chunks(spark, [1, 2, 3, 4, 5, 6, 7]) == [(1, 2), (3, 4), (5, 6), (7, 7)]
    assert chunks(spark, [0, -1]) == []


def test_full_chunks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 1)], "file_id string, total_pages int")
    got = sorted((r.file_id, r.first, r.last) for r in P.full_chunks(df, 2).collect())
    assert got == [("a", 1, 3), ("a", 4, 6), ("a", 7, 9), ("a", 10, 10), ("c", 1, 1)]


def test_budget_is_a_fold(spark):
    df = spark.createDataFrame([("j", 1, 5), ("j", 2, 9), ("j", 3, 2)], "job_id string, file_order int, ocr_pages int")
    got = sorted((r.file_order, r.accepted, r.remaining) for r in P.reserve_pages(df, 8).collect())
    assert got == [(1, True, 3), (2, False, 3), (3, True, 1)]


def test_page_limit(spark):
    df = spark.createDataFrame([(300,), (301,)], "n int").select(P.page_limit_error(F.col("n"), 300))
    first, second = (r[0] for r in df.collect())
    assert first is None and "acima do limite configurado de 300" in second


def test_spine_and_overlay(spark):
    files = spark.createDataFrame([("f", 3), ("none", 0)], "file_id string, total_pages int")
    pages = spark.createDataFrame([("f", 1, "one"), ("f", 3, "three")], "file_id string, page_number long, text string")
    ocr = spark.createDataFrame([("f", 2, " two "), ("f", 3, "\n ")], "file_id string, page_number long, ocr_text string")
    merged = P.ordered_text(P.ocr_overlay(P.page_spine(files, pages), ocr), ["file_id"], "page_number", "text", "\n\n")
    assert [tuple(r) for r in merged.collect()] == [("f", "one\n\ntwo\n\nthree")]


def test_tsv(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    row = lambda line, conf, word, level=5: "\t".join([str(level), "1", "1", "1", str(line), "0", "0", "0", "0", "0", str(conf), word])
    lines = [head, row(1, 90, "a"), row(1, -1, "b"), row(2, 80, "c"), "5\t1", row(2, "x", "d"), row(3, 70, " "), row(3, 10, "e", 4)]
    df = spark.createDataFrame([("p", k, x) for k, x in enumerate(lines)], "page_id string, k int, line string")
    r = O.tsv_text(O.tsv_words(df), ["page_id"], "k").first()
    assert (r.text, r.mean_confidence, r.word_count) == ("a b\nc d", 85.0, 4)


def best(spark, rows, **knobs):
    df = spark.createDataFrame([("p", *r) for r in rows], "page string, attempt int, confidence double, words int, chars int")
    return O.best_attempt(df, ["page"], OcrKnobs(**knobs)).first()


def test_best_attempt(spark):
    assert best(spark, [(1, 90.0, 60, 400), (2, 99.0, 90, 900)]).attempt == 1  # good enough ends the search
    assert best(spark, [(1, 40.0, 10, 50), (2, 60.0, 20, 90)]).attempt == 2
    assert best(spark, [(1, 40.0, 10, 50), (2, 40.0, 10, 50)]).attempt == 1  # the first of equals
    assert best(spark, [(1, 10.0, 10, 50), (2, 20.0, 10, 50), (3, 95.0, 60, 400)]).attempt == 2  # only two are tried


def rotation(spark, base, turned, **knobs):
    b = spark.createDataFrame([("p", base[1], base[0], base[0] * 8)], "page string, confidence double, words int, chars int")
    t = spark.createDataFrame([("p", a, c, w, w * 8) for a, w, c in turned], "page string, angle int, confidence double, words int, chars int")
    return O.rotation_choice(b, t, ["page"], [90, 270], OcrKnobs(**knobs)).first().angle


def test_rotation(spark):
    on = {"rotate": True, "rotate_max_attempts": 2}
    assert rotation(spark, (60, 92.0), [(90, 45, 88.0)], **on) == 0
    assert rotation(spark, (3, 22.0), [(90, 45, 88.0)]) == 0
    assert rotation(spark, (3, 22.0), [(90, 45, 88.0), (270, 12, 45.0)], **on) == 90
    assert rotation(spark, (2, 18.0), [(90, 12, 40.0), (270, 50, 91.0)], **on) == 270
    assert rotation(spark, (12, 20.0), [(90, 4, 99.0), (270, 12, 24.0)], **on) == 0
    assert rotation(spark, (2, 18.0), [(90, 45, 88.0), (270, 50, 91.0)], rotate=True) == 90


def test_settings(spark):
    r = spark.createDataFrame([("90, 270,90,45,x,180",)], "s string").select(rotation_angles(F.col("s"))).first()
    assert r[0] == [90, 270, 180]
    r = spark.createDataFrame([("Title: x\nPages:   12\n", "tool 23.04.0")], "o string, v string").select(pages_in_probe(F.col("o")), version_in_probe(F.col("v"))).first()
    assert tuple(r) == (12, "23.04.0")
    assert env_int({"A": "7x"}, "A", 1) == 7 and env_int({"A": "0"}, "A", 3) == 3 and env_int({}, "A", 3) == 3
    assert env_float({"A": "1.5"}, "A", 2.0) == 1.5 and env_float({"A": "nan"}, "A", 2.0) == 2.0
    assert env_bool({"A": "YES"}, "A", False) and not env_bool({"A": "off"}, "A", True) and env_bool({}, "A", True)


def test_sheets(spark):
    rows = [("f", 0, "Um", 0, ["a", ""]), ("f", 0, "Um", 1, ["", " \xa0"]), ("f", 0, "Um", 2, ["b", "c"]), ("f", 1, "Dois", 0, ["", None])]
    df = spark.createDataFrame(rows, "file_id string, sheet_index int, sheet string, row_index int, cells array<string>")
    r = S.workbook_texts(S.sheet_texts(df)).first()
    assert (r.sheet_count, r.total_cells, r.summary) == (2, 4, "Planilha Excel com 2 aba(s): Um, Dois")
    assert r.text.endswith("=== ABA 1: Um ===\na\t\nb\tc\n\n=== ABA 2: Dois ===\n\n\n")


def test_routes(spark):
    mimes = ["audio/x-any", "foo/pdf", "image/jpg", "text/plain; charset=utf-8", "nothing", "Text/Plain"]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(mimes)], "k int, m string").withColumn("r", M.route(F.col("m"))).orderBy("k")
    got = [(r.r.extractor, r.r.error) for r in df.collect()]
    assert got[:3] == [("audio", None), ("pdf", None), ("image", None)]
    assert got[3:] == [(None, "Unsupported file type: plain; charset=utf-8"), (None, "Unsupported file type: undefined"), (None, "Unsupported file type: Plain")]


def job(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, error string, result string, created_ms long, updated_ms long, started_ms long, finished_ms long")


def test_expiry_and_retention(spark):
    rows = [
        ("queued", "queued", None, None, 0, 40_000, None, None),
        ("running", "processing", None, None, 0, 99_500, 40_000, None),
        ("edge", "queued", None, None, 0, 99_000, None, None),
        ("done", "completed", None, "r", 0, 0, None, 40_000),
        ("fresh", "completed", None, "r", 0, 0, None, 99_500),
        ("unreadable", "queued", None, None, None, None, None, None),
    ]
    told = {r.id: r.status for r in J.expire_stale(job(spark, rows), 100_000, 1000).collect()}
    assert told == {"queued": "expired", "running": "expired", "edge": "queued", "done": "completed", "fresh": "completed", "unreadable": "expired"}
    assert {r.id for r in J.retained(job(spark, rows), 100_000, 1000).collect()} == {"queued", "running", "edge", "fresh", "unreadable"}
    after = {r.id: r.status for r in J.maintain(job(spark, rows), 100_000, Limits(jobs_stale_ms=1000, jobs_retention_ms=1000)).collect()}
    assert "done" not in after and after["queued"] == "expired"


def test_updates_and_queue(spark):
    rows = [("a", "queued", None, None, 0, 0, None, None), ("b", "expired", "old", None, 0, 0, None, 5), ("c", "processing", None, None, 3, 0, 1, None)]
    up = spark.createDataFrame([("b", "completed", "r"), ("c", "completed", "r")], "id string, status string, result string")
    got = {r.id: (r.status, r.result, r.updated_ms) for r in J.updated(job(spark, rows), up, 9).collect()}
    assert got == {"a": ("queued", None, 0), "b": ("expired", None, 0), "c": ("completed", "r", 9)}
    queue = spark.createDataFrame([("a", 1), ("c", 2), ("gone", 3)], "job_id string, position int")
    assert {r.job_id: r.outcome for r in J.pruned_queue(queue, job(spark, rows), 100, 99).collect()} == {"a": "expired", "c": "dropped", "gone": "dropped"}
    assert {r.job_id: r.outcome for r in J.pruned_queue(queue, job(spark, rows), 99, 99).collect()}["a"] == "kept"
    assert [r.id for r in J.dispatched(job(spark, rows), 1).collect()] == ["a"]
    assert {r.id: r.accepted for r in J.admitted(job(spark, rows), 98, 100).collect()} == {"a": True, "b": True, "c": False}


def test_job_ids(spark):
    ids = ["123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-42D3-A456-426614174000", "../secret", "123e4567-e89b-62d3-a456-426614174000"]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select(J.valid_job_id(F.col("i")))
    assert [r[0] for r in df.collect()] == [True, True, False, False]


def test_new_jobs(spark):
    df = spark.createDataFrame([("[]",), ("[1]",)], "request string")
    rows = J.new_jobs(df, 7, "h").collect()
    assert {(r.status, r.created_ms, r.host, r.error) for r in rows} == {("queued", 7, "h", None)} and len({r.id for r in rows}) == 2
    assert all(r[0] for r in J.new_jobs(df, 7, "h").select(F.length("id") == 36).collect())
