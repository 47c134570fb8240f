import json

import pytest
from pyspark.sql import functions as F

from pagemill.config import Limits, OcrKnobs, knobs_from_env, limits_from_env
from pagemill.operators.jobs import RECORD_SCHEMA
from pagemill.operators.pages import reserve_pages
from pagemill.sources import readers, sinks
from pagemill.sources.joblog import JobLog
from pagemill.streaming import jobs
from pagemill.streaming.jobs import follow_jobs, job_stream, merge_arrivals, request_stream


def records(spark, *rows):
    """(id, status, created_ms) as records."""
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "id string, status string, created_ms long, updated_ms long")
    names = [c.split() for c in RECORD_SCHEMA.split(", ")]
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in names])


def state(log, before=None):
    return {r.id: r.status for r in log.read(before).collect()}


def test_latest_change_is_the_record(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"), RECORD_SCHEMA)
    assert log.batches() == [] and log.read().count() == 0
    alive = lambda df: df.withColumn("deleted", F.lit(False))
    log.write(1, alive(records(spark, ("a", "queued", 1), ("b", "queued", 2))))
    log.write(2, alive(records(spark, ("a", "processing", 1))))
    files = lambda n: {p.name: p.read_bytes() for p in (tmp_path / "log" / f"batch={n}").glob("part-*")}
    first = files(1)
    log.write(3, records(spark, ("b", "queued", 2), ("c", "queued", 3)).withColumn("deleted", F.col("id") == "b"))
    assert files(1) == first  # a tick writes its changes and nothing else
    assert state(log) == {"a": "processing", "c": "queued"} and state(log, before=2) == {"a": "queued", "b": "queued"}
    log.write(3, records(spark, ("b", "queued", 2), ("c", "queued", 3)).withColumn("deleted", F.col("id") == "b"))
    assert state(log) == {"a": "processing", "c": "queued"} and log.changes().count() == 5
    log.delete(4, spark.createDataFrame([("c",), ("c",), ("none",)], "id string"))
    assert state(log) == {"a": "processing"}


def test_compaction_keeps_what_is_read(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"), RECORD_SCHEMA)
    for n in range(6):
        log.write(n, records(spark, (f"j{n}", "queued", n), (f"j{n // 2}", "processing", n)).dropDuplicates(["id"]).withColumn("deleted", F.col("id") == "j1"))
    want = state(log)
    log.compact(3)
    assert log.batches() == [3, 4, 5] and state(log) == want
    assert {r.id for r in log.changes().where("deleted").collect()} == {"j1"}  # an older change of it may still have been there
    log.compact(5)
    assert log.batches() == [5] and state(log) == want and log.changes().where("deleted").count() == 0
    log.compact(5)
    assert log.batches() == [5]


def test_a_batch_that_runs_again_decides_the_same(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"), RECORD_SCHEMA)
    no = str(tmp_path / "no")
    limits = Limits(jobs_max_queue=2)
    arrivals = records(spark, *[(f"j{k}", None, k) for k in range(5)])
    for _ in range(3):
        merge_arrivals(log, 0, arrivals, 100, limits, no)
        assert state(log) == {"j0": "processing", "j1": "queued"}
        assert {(r.id, r.http_status, r.error, r.at_ms) for r in spark.read.parquet(no).collect()} == {(f"j{k}", 503, "JobQueueFullError", 100) for k in (2, 3, 4)}
    merge_arrivals(log, 1, records(spark, ("j0", None, 0), ("j9", None, 9)), 200, limits, no)
    assert state(log) == {"j0": "processing", "j1": "queued", "j9": "queued"}
    assert log.changes().where("batch = 1").count() == 1


def test_job_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    limits = Limits(jobs_max_queue=2, jobs_stale_ms=1000, jobs_retention_ms=3000)
    run = lambda now: job_stream(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck"), limits, clock=lambda: now, once=True, rejections=str(tmp_path / "no")).awaitTermination()
    put = lambda k, created: (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"id": f"j{k}", "created_ms": created}))
    for k in range(3):
        put(k, k)
    run(100)
    log = JobLog(spark, str(tmp_path / "log"), RECORD_SCHEMA)
    assert state(log) == {"j0": "processing", "j1": "queued"} and [r.id for r in spark.read.parquet(str(tmp_path / "no")).collect()] == ["j2"]
    put(3, 5)
    run(5000)  # a new stream on the same checkpoint: both old jobs are stale by now
    assert state(log) == {"j0": "expired", "j1": "expired", "j3": "processing"}
    put(4, 8500)
    run(8500)  # what expired is past retention, and so is gone
    assert state(log) == {"j3": "expired", "j4": "processing"}


GOOD = {"conversationId": "c", "body": {"files": [{"fileId": "f", "url": "https://a.b/c", "mimeType": "text/plain"}]}}


def test_requests_ended_between_two_sinks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps([GOOD, GOOD] if k % 2 == 0 else [GOOD, {"conversationId": 5}]))
    (tmp_path / "in" / "x.json").write_text("{nothing")
    log = JobLog(spark, str(tmp_path / "log"), RECORD_SCHEMA)
    clocks = iter(range(1000, 2000, 100))

    def run():
        q = request_stream(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck"), "h", str(tmp_path / "bad"), str(tmp_path / "no"), Limits(jobs_max_queue=2), clock=lambda: next(clocks), once=True)
        q.awaitTermination()

    whole = jobs.sink_batch
    calls = []

    def breaks(rows, path, batch):
        calls.append(path)
        if len(calls) == 2:  # after quarantine, before rejections and the log
            raise RuntimeError("killed")
        whole(rows, path, batch)

    monkeypatch.setattr(jobs, "sink_batch", breaks)
    with pytest.raises(Exception, match="killed"):
        run()
    assert log.batches() == [] and len(calls) == 2
    write = JobLog.write

    def breaks_after(self, *a):
        write(self, *a)
        raise RuntimeError("killed again")

    monkeypatch.setattr(JobLog, "write", breaks_after)
    with pytest.raises(Exception, match="killed again"):
        run()
    monkeypatch.setattr(JobLog, "write", write)
    run()
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted(r.source_file.rpartition("/")[2] for r in bad) == ["1.json", "3.json", "5.json", "x.json"] and all(r.http_status == 400 and r.issues for r in bad)
    got = log.read().collect()
    refused = spark.read.parquet(str(tmp_path / "no")).collect()
    assert sorted(r.status for r in got) == ["processing", "queued"] and len(refused) == 1
    assert len({r.id for r in got} | {r.id for r in refused}) == 3 and {r.created_ms for r in got} == {1000} == {refused[0].at_ms}
    assert all(json.loads(r.request) == [GOOD, GOOD] and r.type == "process-message" for r in got)
    (tmp_path / "in" / "7.json").write_text(json.dumps(GOOD))
    run()
    assert log.read().count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 4


def test_followed_jobs_leave_no_state(spark, tmp_path):
    def write(k, rows):
        df = spark.createDataFrame(rows, "id string, status string, s long").select("id", "status", F.timestamp_seconds(F.col("s") + 1000).alias("at"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))

    def run():
        stream = spark.readStream.schema("id string, status string, at timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        told = follow_jobs(stream, stale_ms=60_000, retention_ms=300_000, lateness="1 second")
        out = []
        q = told.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r[0], r[1], r[2] // 1000 - 1000) for r in out}, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    write(1, [("a", "queued", 0), ("b", "queued", 0)])
    run()
    write(2, [("b", "completed", 30), ("c", "queued", 100)])
    told, _ = run()  # each run is a new stream on the same checkpoint
    assert ("b", "completed", 30) in told and ("a", "expired", 60) in told
    write(3, [("b", "processing", 101), ("c", "failed", 102)])
    told, held = run()
    assert ("b", "completed", 30) in told and ("c", "failed", 102) in told
    write(4, [("z", "completed", 1000)])
    told, held = run()
    assert {("a", "deleted", 360), ("b", "deleted", 330), ("c", "deleted", 402)} <= told
    write(5, [("late", "queued", 5), ("y", "completed", 1400)])
    told, held = run()
    assert ("z", "deleted", 1300) in told and not any(t[0] == "late" for t in told)
    assert held <= 3  # y alone: its record and its timer


def test_texts_under_their_names(spark, tmp_path):
    texts = spark.createDataFrame([("c1", "a\nb"), ("c2", "é"), ("../up", "x"), ("c2", "z"), ("c3", None), (None, "n")], "conversation_id string, text string")
    out = str(tmp_path / "texts")
    sinks.write_texts(texts, out, 99)
    found = {str(p.relative_to(out)): p.read_text() for p in (tmp_path / "texts").rglob("*") if p.is_file()}
    assert found == {"c1/c1-99.txt": "a\nb", "c2/c2-99.txt": "z", "c2/c2-99-1.txt": "é", "c3/c3-99.txt": ""} and not (tmp_path / "up").exists()
    sinks.write_texts(texts, out, 99)  # again: the same files
    assert len([p for p in (tmp_path / "texts").rglob("*") if p.is_file()]) == 4
    listed = readers.list_outputs(spark, out).collect()
    assert ("c1", "c1-99.txt") in {(r.conversation_id, r.file_name) for r in listed}


def test_a_task_that_failed_leaves_no_part(tmp_path):
    writer = sinks.FileWriter(str(tmp_path))

    def rows(broken):
        yield {"name": "a/a-5.txt", "text": "first"}
        if broken:
            raise RuntimeError("lost")
        yield {"name": "b/b-5.txt", "text": "second"}

    with pytest.raises(RuntimeError):
        writer.write(rows(True))
    told = writer.write(rows(False))  # the task runs again
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a-5.txt", "b-5.txt"] and told.files == ["a/a-5.txt", "b/b-5.txt"]
    writer.abort([told, None])
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    with pytest.raises(AttributeError):
        writer.write(iter([{"name": "a/a-5.txt", "text": 5}]))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_point_lookup_reads_one_file(spark, tmp_path):
    ids = [f"123e4567-e89b-12d3-a456-4266141740{k:02d}" for k in range(30)]
    for x in ids:
        (tmp_path / f"{x}.json").write_text(json.dumps({"id": x, "status": "queued", "created_ms": 5, "request": [{"a": 1}]}))
    (tmp_path / "notes.json").write_text("{}")
    (tmp_path / "223e4567-e89b-12d3-a456-426614174000.json").write_text("{broken")
    jobs_ = readers.read_job_files(spark, str(tmp_path))
    assert jobs_.count() == 30 and jobs_.where(F.col("id") == ids[3]).collect()[0].request == '[{"a":1}]'
    assert {r.id for r in jobs_.where(F.col("id").isin(ids[1], ids[2], "none", "../x")).collect()} == {ids[1], ids[2]}
    assert jobs_.where("id = 'none'").count() == 0 and jobs_.where("status = 'queued'").count() == 30
    reader = readers.JobReader(str(tmp_path), jobs_.schema)
    assert list(reader.pushFilters([readers.EqualTo(("id",), ids[7])])) and [p.names for p in reader.partitions()] == [[ids[7]]]
    looked = readers.JobReader(str(tmp_path / "not there"), jobs_.schema)
    looked.pushFilters([readers.In(("id",), (ids[0],))])
    assert list(looked.read(readers.Names([ids[0]]))) == [] and looked.partitions()[0].names == []
    for x in ids[1:]:  # what isn't asked for isn't opened: reading these would fail
        (tmp_path / f"{x}.json").unlink()
        (tmp_path / f"{x}.json").mkdir()
    assert [r.id for r in jobs_.where(F.col("id") == ids[0]).collect()] == [ids[0]]


def test_a_budget_over_a_million_files(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").alias("file_order"), (F.col("id") * 7919 % 13).alias("ocr_pages")).union(spark.createDataFrame([(None, 0, 5), (None, 1, None), (2, 5, 9), (2, 5, 2)], "job_id int, file_order long, ocr_pages long"))
    told = reserve_pages(rows, 1000)
    used = want = 0
    for k in range(n):
        p = k * 7919 % 13
        if used + p <= 1000:
            used, want = used + p, want + 1
    assert told.where("job_id = 1 AND accepted").count() == want and "array" not in told._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(map(tuple, reserve_pages(rows.where("job_id = 2"), 8).collect())) == [(2, 5, 2, True, 6), (2, 5, 9, False, 6)]
    assert sorted(tuple(r)[1:] for r in told.where("job_id IS NULL").collect()) == [(0, 5, True, 995), (1, 0, True, 995)]


def test_limits_of_the_environment():
    assert limits_from_env({"PAGEMILL_MAX_PDF_PAGES": "7x", "PAGEMILL_JOBS_MAX_QUEUE": "-3", "PAGEMILL_OCR_ALWAYS_PAGES": " 9 "}) == Limits(max_pdf_pages=7, ocr_always_pages=9)
    env = {"PAGEMILL_OCR_MODE": "3", "PAGEMILL_OCR_ROTATE": " Yes ", "PAGEMILL_OCR_ROTATE_MIN_GAIN": "2.5", "PAGEMILL_OCR_LAT": " 5x5 ", "PAGEMILL_OCR_THRESHOLD": " ", "PAGEMILL_OCR_SCALE": "0", "PAGEMILL_OCR_DESKEW": "x"}
    assert knobs_from_env(env) == OcrKnobs(mode=3, rotate=True, rotate_min_gain=2.5, lat="5x5")
    assert knobs_from_env({}) == OcrKnobs()
