"""Queries over steps that run engines within tasks or keep state between batches, each beside the SQL that says the same."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits, OcrKnobs
from ..functions.ocr_score import languages_listed, ocr_language, pages_in_probe, rotation_angles, version_in_probe
from ..operators import jobs as J
from ..operators import messages as M
from ..operators import ocr as O
from ..operators import pages as P
from ..operators.attempts import climbed
from ..sources.engines import extract_pages, native_pages, probe_files, recognise_pages
from ..sources.extract import extract_sheets, extract_texts, plain_text, registry
from ..sources.folders import kept, scratch_path
from ..sources.joblog import JobLog
from ..sources.ladder import Rung
from ..sources.readers import list_outputs, read_job_files
from ..sources.sinks import write_files, write_texts
from ..streaming.jobs import follow_jobs, merge_requests, sink_batch, table_stream
from . import tables as T
from .queries import _ATTEMPTS, _BLOCKS, _CHUNKS, _FILES, _JOBS, _JOINED, _MESSAGES, _OVERLAY, _ROUTED, _STATUS, MIXED
from .queries import _decided, _overlaid, _processed, _sanitize, _sanitize_text, _trim, query

#: Seconds that the image engine of timed_extraction may take.
LIMIT = 1.5
HANGS = b"<!-- hangs -->"


def _image_text(content: bytes) -> str:
    """An engine that never comes back from some files."""
    while content.startswith(HANGS):
        time.sleep(60)
    return plain_text(content)


@query(
    f"""{_JOBS}, {_FILES}, {_ROUTED}, new_ AS (SELECT page_id // 8 AS id, min(CASE WHEN page_id % 240 = 2 THEN 'O processamento deste arquivo IMAGE excedeu o tempo limite de {LIMIT:g} segundos.' END) AS e,
        count(*) AS n_read, count(*) FILTER (page_id % 240 = 2) AS n_overdue FROM typed_ WHERE extractor IS NOT NULL GROUP BY 1)
    SELECT j.id, CASE WHEN n.id IS NULL OR j.status IN ('completed', 'failed', 'expired') THEN j.status WHEN n.e IS NULL THEN 'completed' ELSE 'expired' END AS status,
    CASE WHEN n.id IS NULL OR j.status IN ('completed', 'failed', 'expired') THEN j.error ELSE coalesce(n.e, j.error) END AS error,
    coalesce(n.n_read - n.n_overdue, 0) AS n_texts, coalesce(n.n_overdue, 0) AS n_overdue FROM jobs_ j LEFT JOIN new_ n ON n.id = j.id"""
)
def timed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read under time limits, some of which hang their engine: those are ended and their jobs expire, the others are read and complete theirs."""
    files = T.message_files(spark, sf_dir).withColumn("extractor", M.route(F.col("mime_type"))["extractor"])
    content = F.concat(F.when(F.col("page_id") % 240 == 2, HANGS.decode()).otherwise(""), "html")
    told = T.spread(files.select("file_id", "extractor", F.encode(content, "UTF-8").alias("content")))
    limits = dict.fromkeys(M.TIMEOUT_SECONDS, 60.0) | {"image": LIMIT}
    read = extract_texts(told, registry(image=_image_text) | dict.fromkeys(("pdf", "audio", "doc", "docx", "xlsx"), plain_text), clean=False, limits=limits)
    job = F.floor(F.substring("file_id", 2, 20).cast("long") / 8)
    ended = read.groupBy(job.alias("id")).agg(F.min("error").alias("error"), F.count("value").alias("n_texts"), F.count_if("overdue").alias("n_overdue"))
    jobs = T.job_records(spark, sf_dir)
    after = J.updated(jobs, ended.select("id", J.completion(F.col("error")).alias("status"), "error"), T.NOW_MS)
    counts = ended.select("id", "n_texts", "n_overdue")
    return after.select("id", "status", "error").join(counts, "id", "left").fillna(0, ["n_texts", "n_overdue"])


@query(
    _ATTEMPTS
    + """, numbered_ AS (SELECT *, (page + attempt) % 13 = 0 AS fails, row_number() OVER (PARTITION BY page ORDER BY attempt) AS k FROM scored_),
    stops_ AS (SELECT page, bool_or(k = 1 AND fails) AS none, min(CASE WHEN good AND NOT fails AND k <= 3 THEN k END) AS stop, least(count(*), 3) AS n FROM numbered_ GROUP BY page),
    made_ AS (SELECT *, CASE WHEN none THEN 1 ELSE coalesce(stop, n) END AS made FROM stops_),
    ranked_ AS (SELECT m.page, m.made, x.attempt, x.score, x.fails, row_number() OVER (PARTITION BY m.page ORDER BY x.fails, x.k = m.stop DESC NULLS LAST, x.score DESC, x.k) AS rank,
        count(*) FILTER (x.fails) OVER (PARTITION BY m.page) AS failed FROM made_ m JOIN numbered_ x ON x.page = m.page AND x.k <= m.made)
    SELECT page, CASE WHEN NOT fails THEN attempt END AS attempt, CASE WHEN NOT fails THEN round(score, 6) END AS score, made, failed FROM ranked_ WHERE rank = 1"""
)
def attempt_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts made one by one, none after the first that is good enough; some fail and are skipped, and a first one that fails is the last."""
    attempts = T.attempts(spark, sf_dir).withColumn("failed", (F.col("page") + F.col("attempt")) % 13 == 0)
    return climbed(attempts, "page", OcrKnobs(max_attempts=3)).withColumn("score", F.round("score", 6))


@query(
    MIXED
    + _CHUNKS
    + _OVERLAY
    + f""", outcomes_ AS (SELECT file_id, first, CASE WHEN (file_id + first) % 5 = 0 THEN 'no raster of page ' || first END AS error FROM chunks_),
    ocr_errors_ AS (SELECT file_id, count(*) AS chunks, count(error) AS failed_chunks, 'Erro no processamento OCR: ' || arg_min(error, first) FILTER (error IS NOT NULL) AS ocr_error FROM outcomes_ GROUP BY file_id),
    native_ AS (SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER ({_trim('text')} <> '') AS text FROM pages_ GROUP BY file_id),
    merged_ AS (SELECT file_id, string_agg(merged, chr(10) || chr(10) ORDER BY page_number) FILTER ({_trim('merged')} <> '') AS text FROM overlay_ GROUP BY file_id),
    told_ AS (SELECT m.file_id, coalesce(e.chunks, 0) AS chunks, coalesce(e.failed_chunks, 0) AS failed_chunks, e.ocr_error, coalesce(n.text, '') AS native, m.text AS merged
        FROM merged_ m LEFT JOIN ocr_errors_ e ON e.file_id = m.file_id LEFT JOIN native_ n ON n.file_id = m.file_id)
    SELECT file_id, chunks, failed_chunks, CASE WHEN ocr_error IS NULL THEN {_sanitize('merged')} WHEN {_trim('native')} <> '' THEN {_sanitize(_trim('native'))} END AS value,
           CASE WHEN {_trim('native')} = '' THEN ocr_error END AS error FROM told_"""
)
def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of chunks folded by file: one failed chunk fails the file's OCR, and then its native text stands, or the error."""
    decided = kept(_decided(spark, sf_dir).select("file_id", "page_number", "text", "should_ocr", "has_visual_content", "embedded_image_count", "table_count"))
    chunks = P.selected_chunks(decided.where("should_ocr"))
    outcomes = chunks.withColumn("error", F.when((F.col("file_id") + F.col("first")) % 5 == 0, F.concat(F.lit("no raster of page "), F.col("first").cast("string"))))
    errors = O.chunk_errors(outcomes)
    native = P.ordered_text(T.native_pages(spark, sf_dir), ["file_id"], "page_number", "text", "\n\n").withColumnRenamed("text", "native")
    merged = P.ordered_text(_overlaid(spark, sf_dir, decided), ["file_id"], "page_number", "text", "\n\n")
    counts = P.page_counts(decided, "file_id").select("file_id", "ocr_pages")
    told = merged.join(counts, "file_id").join(native, "file_id", "left").join(errors, "file_id", "left").fillna(0, ["chunks", "failed_chunks"])
    result = P.mixed_result(F.coalesce("native", F.lit("")), F.col("text"), F.col("ocr_pages"), F.col("ocr_error"))
    return told.withColumn("r", result).select("file_id", "chunks", "failed_chunks", "r.value", "r.error")


@query(
    f"""WITH changes_ AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, epoch_us(ts) // 86400000000 % 4 AS batch, CASE event_type {_STATUS} ELSE 'queued' END AS status FROM events),
    latest_ AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, at_ms DESC, event_id DESC) AS k FROM changes_)
    SELECT CAST(user_id AS VARCHAR) AS id, status, at_ms AS updated_ms FROM latest_ WHERE k = 1 AND status <> 'failed'"""
)
def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of jobs logged in four batches, folded together in between, and read as records; a failed job is deleted."""
    log = JobLog(spark, scratch_path(spark, "logs"), J.RECORD_SCHEMA)
    jobs = T.job_records(spark, sf_dir).withColumn("day", F.floor(F.col("created_ms") / 86_400_000) % 4)
    row = F.struct("created_ms", "id", "status")
    changed = jobs.groupBy("day", F.col("user_id").cast("string").alias("user")).agg(F.max(row).alias("r"))
    null = {c: F.lit(None).cast(t) for c, t in (x.split() for x in J.RECORD_SCHEMA.split(", "))}
    known = {"id": F.col("user"), "status": F.col("r.status"), "updated_ms": F.col("r.created_ms")}
    for day in range(4):
        log.write(day, changed.where(F.col("day") == day).withColumn("deleted", F.col("r.status") == "failed").select("deleted", *[(known.get(c, v)).alias(c) for c, v in null.items()]))
        if day == 2:
            log.compact(day)
    return log.read().select("id", "status", "updated_ms")


_STALE_MS, _RETENTION_MS, _LATE_MS = 3_600_000, 7_200_000, 600_000


@query(
    f"""WITH seen_ AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, CASE event_type {_STATUS} ELSE 'queued' END AS status FROM events),
    ends_ AS (SELECT user_id, min((at_ms, status)) FILTER (status IN ('completed', 'failed', 'expired')) AS e, max((at_ms, status)) AS l FROM seen_ GROUP BY user_id),
    now_ AS (SELECT user_id, e IS NULL AS open, coalesce(e, l)[1] AS at_ms, coalesce(e, l)[2] AS status FROM ends_),
    mark_ AS (SELECT max(at_ms) - {_LATE_MS} AS mark FROM seen_)
    SELECT CAST(user_id AS VARCHAR) AS id, status, at_ms FROM now_
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'expired', at_ms + {_STALE_MS} FROM now_, mark_ WHERE open AND at_ms + {_STALE_MS} <= mark
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'deleted', at_ms + {_RETENTION_MS} FROM now_, mark_ WHERE NOT open AND at_ms + {_RETENTION_MS} <= mark"""
)
def followed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of changes tells of jobs: each one's state, then, as event time goes on, which expire and which finished ones are forgotten."""
    source = table_stream(spark, sf_dir, "events.parquet", T.table(spark, sf_dir, "events").schema)
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in T.STATUS_OF.items()], F.lit("queued"))
    changes = source.select(F.col("user_id").cast("string").alias("id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))
    told = follow_jobs(changes, _STALE_MS, _RETENTION_MS, f"{_LATE_MS} milliseconds")
    path = scratch_path(spark, "streams")
    write = lambda batch, n: sink_batch(batch, f"{path}/rows", n)
    told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string, status string, at_ms long, batch int").parquet(f"{path}/rows").drop("batch")


@query(
    _MESSAGES
    + """, bad_ AS (SELECT request_id, conversation_id IS NULL OR NOT has_body OR (n >= 1 AND (NOT has_id OR NOT has_url)) OR (n >= 2 AND NOT has_second) AS bad FROM messages_),
    requests_ AS (SELECT request_id, bool_or(bad) AS bad, sha256('request-' || request_id) AS h FROM bad_ GROUP BY request_id),
    named_ AS (SELECT *, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] AS id FROM requests_),
    placed_ AS (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY id) AS k FROM named_)
    SELECT CASE WHEN bad THEN 'request-' || request_id ELSE id END AS place, CASE WHEN bad THEN 'invalid' WHEN k > 20 THEN 'refused' WHEN k = 1 THEN 'processing' ELSE 'queued' END AS outcome,
    CASE WHEN bad THEN 400 WHEN k > 20 THEN 503 ELSE 202 END AS http_status FROM placed_"""
)
def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one batch into their three sinks: jobs in the log, quarantine, rejections."""
    m = T.messages(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.struct("message_index", F.struct("conversationId", "body").alias("m"))))
    value = F.to_json(F.transform(listed, lambda x: x["m"]))
    requests = m.groupBy(F.concat(F.lit("request-"), F.col("request_id").cast("string")).alias("source_file")).agg(value.alias("value"))
    path = scratch_path(spark, "requests")
    log = JobLog(spark, f"{path}/log", J.RECORD_SCHEMA)
    merge_requests(log, 0, requests, T.NOW_MS, "files.example.com", f"{path}/bad", f"{path}/no", Limits(jobs_max_queue=20))
    bad = spark.read.schema("source_file string, http_status int, error string, issues array<string>").parquet(f"{path}/bad")
    no = spark.read.schema("id string, http_status int, error string, at_ms long").parquet(f"{path}/no")
    jobs = log.read().select(F.col("id").alias("place"), F.col("status").alias("outcome"), F.lit(202).alias("http_status"))
    refused = no.select(F.col("id").alias("place"), F.lit("refused").alias("outcome"), "http_status")
    return jobs.unionByName(refused).unionByName(bad.select(F.col("source_file").alias("place"), F.lit("invalid").alias("outcome"), "http_status"))


@query(
    f"WITH {_BLOCKS}, listed_ AS (SELECT conversation_id, {_JOINED} AS joined FROM blocks_ GROUP BY conversation_id) "
    f"SELECT conversation_id, conversation_id || '-{T.NOW_MS}.txt' AS file_name, sha256({_sanitize_text(_trim('joined'))}) AS text_sha256 FROM listed_"
)
def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of conversations written as files under the names that their addresses promise, and read again."""
    path = scratch_path(spark, "texts")
    write_texts(M.assembled(_processed(spark, sf_dir), T.NOW_MS, "files.example.com").select("conversation_id", "text"), path, T.NOW_MS)
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select("value", F.split(F.input_file_name(), "/").alias("parts"))
    return files.select(F.element_at("parts", -2).alias("conversation_id"), F.element_at("parts", -1).alias("file_name"), F.sha2("value", 256).alias("text_sha256"))


_TURN_FILES = """turns_ AS (SELECT 't-' || conv_id || '-' || turn AS file_id, CASE WHEN turn % 2 = 0 THEN text ELSE replace(text, chr(10), chr(10) || chr(10)) END AS raw FROM conversations),
    books_ AS (SELECT 'b-' || c_custkey // 50 AS file_id, count(*) AS n, string_agg(c_name || chr(9) || c_custkey || chr(9) || c_mktsegment, chr(10) ORDER BY c_custkey) AS body FROM customer GROUP BY 1),
    raw_ AS (SELECT file_id, raw FROM turns_ UNION ALL SELECT file_id, '=== ARQUIVO EXCEL ===' || chr(10) || 'Resumo: Planilha Excel com 1 aba(s): Clientes' || chr(10) || 'Total de abas: 1' || chr(10)
        || 'Total de células: ' || 3 * n || chr(10) || chr(10) || '=== ABA 1: Clientes ===' || chr(10) || body || chr(10) || chr(10) FROM books_)"""


@query(f"WITH {_TURN_FILES} SELECT file_id, {_sanitize('raw')} AS value, CAST(NULL AS VARCHAR) AS error FROM raw_")
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files, word-processing documents and workbooks read by the extractors of their kinds."""
    return extract_texts(T.staged_files(spark, sf_dir), registry()).select("file_id", "value", "error")


@query("SELECT 'b-' || c_custkey // 50 AS file_id, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS row_index, 'Clientes' AS sheet, c_name || '|' || c_custkey || '|' || c_mktsegment AS cells FROM customer")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of workbooks as their files hold them."""
    books = T.staged_files(spark, sf_dir).where("extractor = 'xlsx'")
    return extract_sheets(books).select("file_id", F.col("row_index").cast("long").alias("row_index"), "sheet", F.array_join("cells", "|").alias("cells"))


def _paged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, content: the turns of a conversation as the pages of a file, a form feed between them; every ninth file can't be read."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    text = F.array_join(F.transform(listed, lambda p: p["text"]), "\f")
    files = T.native_pages(spark, sf_dir).groupBy("file_id").agg(text.alias("text"))
    return files.select("file_id", F.encode(F.when(F.col("file_id") % 9 == 4, "broken").otherwise(F.col("text")), "UTF-8").alias("content"))


def _pages_of(content: bytes) -> list[tuple[str, int, int]]:
    if content == b"broken":
        raise ValueError("no pages")
    return [(t, t.count("la"), t.count("en") // 5) for t in content.decode().split("\f")]


@query(
    """SELECT conv_id AS file_id, turn + 1 AS page_number, sha256(text) AS text_sha256, (length(text) - length(replace(text, 'la', ''))) // 2 AS embedded_image_count,
    (length(text) - length(replace(text, 'en', ''))) // 2 // 5 AS table_count, max(turn + 1) OVER (PARTITION BY conv_id) AS total_pages, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE conv_id % 9 <> 4
    UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, NULL, 'no pages' FROM conversations WHERE conv_id % 9 = 4"""
)
def engine_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine of pages tells of each page of files; those that it fails on are a row with the error."""
    told = extract_pages(_paged_files(spark, sf_dir), _pages_of)
    return told.select("file_id", *[F.col(c).cast("long").alias(c) for c in ("page_number", "embedded_image_count", "table_count", "total_pages")], F.sha2("text", 256).alias("text_sha256"), "error")


@query("SELECT conv_id AS file_id, conv_id % 9 <> 4 AS valid, CASE WHEN conv_id % 9 = 4 THEN 0 ELSE max(turn + 1) END AS page_count FROM conversations GROUP BY conv_id")
def file_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a probe finds a file sound, and its number of pages."""
    return probe_files(_paged_files(spark, sf_dir), lambda content: (True, len(_pages_of(content))))


#: Bytes of a page of the files that recognised_pages reads.
PAGE_BYTES = 8192


def _raster(file, first: int, last: int) -> list[bytes]:
    """Pages first to last of a file of pages of one size, and nothing else of it."""
    pages = []
    for page in range(first, last + 1):
        file.seek((page - 1) * PAGE_BYTES)
        pages.append(file.read(PAGE_BYTES))
    if any(page.startswith(b"X") for page in pages):
        raise ValueError("no raster")
    return pages


def _recogniser(image: bytes, rung: Rung) -> str:
    """Every word of a page in a line for each of its lines; a look at a prepared image is surer."""
    if rung.label == "orig" and image.startswith(b"E"):
        raise ValueError("no reading")
    sure = 60 if rung.label == "orig" else 90
    lines = image.decode().rstrip(" ").split("\n")
    return "\n".join("\t".join(["5", "1", "1", "1", str(k), "0", "0", "0", "9", "9", str(sure), w]) for k, line in enumerate(lines) for w in line.split(" ") if w)


_WORDS = r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g'))), lambda l: l <> ''), chr(10))"


@query(
    f"""WITH pages_ AS (SELECT conv_id AS file_id, turn + 1 AS page_number, turn // 2 AS chunk, text, starts_with(text, 'X') AS fails, starts_with(text, 'E') AS unread, {_WORDS} AS read FROM conversations),
    counted_ AS (SELECT *, bool_or(fails) OVER (PARTITION BY file_id, chunk) AS broken, len(string_split(replace(read, chr(10), ' '), ' ')) AS n FROM pages_)
    SELECT file_id, page_number, read AS text, 90.0::DOUBLE AS confidence, CAST(n AS BIGINT) AS words, 'prep' AS rung, 2 AS attempts, CAST(NULL AS VARCHAR) AS error FROM counted_ WHERE NOT broken AND NOT unread AND read <> ''
    UNION ALL SELECT DISTINCT file_id, NULL::BIGINT, NULL, NULL, NULL, NULL, NULL, 'no raster' FROM counted_ WHERE broken GROUP BY file_id, chunk
    UNION ALL SELECT file_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM counted_ WHERE NOT broken GROUP BY file_id, chunk HAVING bool_and(unread OR read = '')"""
)
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages recognised chunk by chunk: tasks read the files' ranges by path, look twice at each page, and chunks that fail are told."""
    path = scratch_path(spark, "files")
    pages = T.native_pages(spark, sf_dir)
    padded = F.rpad(F.encode("text", "UTF-8"), PAGE_BYTES, F.encode(F.lit(" "), "UTF-8"))
    files = pages.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_number", padded.alias("page")))).alias("p"), F.max("page_number").alias("last"))
    text = F.decode(F.aggregate("p", F.encode(F.lit(""), "UTF-8"), lambda acc, x: F.concat(acc, x["page"])), "UTF-8")
    write_files(files.select(F.concat(F.col("file_id").cast("string"), F.lit(".bin")).alias("name"), text.alias("text")), path)
    chunks = pages.groupBy("file_id", F.floor((F.col("page_number") - 1) / 2).alias("k")).agg(F.min("page_number").alias("first"), F.max("page_number").alias("last"))
    asked = chunks.select("file_id", F.concat(F.lit(f"{path}/"), F.col("file_id").cast("string"), F.lit(".bin")).alias("path"), "first", "last")
    return recognise_pages(asked, _raster, _recogniser, lambda image, rung: image).select("file_id", "page_number", "text", "confidence", "words", "rung", "attempts", "error")


@query(
    _JOBS
    + """, users_ AS (SELECT user_id, arg_max(status, (created_ms, id)) AS status, max(created_ms) AS created_ms, md5('job-' || user_id) AS h FROM jobs_ GROUP BY user_id)
    SELECT h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] AS id, status, created_ms FROM users_"""
)
def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as a JSON file each and read from the folder again."""
    path = scratch_path(spark, "jobs")
    h = F.md5(F.concat(F.lit("job-"), F.col("user_id").cast("string")))
    own = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    users = T.job_records(spark, sf_dir).groupBy("user_id").agg(F.max_by("status", F.struct("created_ms", "id")).alias("status"), F.max("created_ms").alias("created_ms"))
    record = users.select(own.alias("id"), "status", "created_ms")
    write_files(record.select(F.concat("id", F.lit(".json")).alias("name"), F.to_json(F.struct("id", "status", "created_ms")).alias("text")), path)
    return read_job_files(spark, path).select("id", "status", "created_ms")


@query(
    f"""WITH {_FILES} SELECT conversation_id, conversation_id || '-{T.NOW_MS}.txt' AS file_name FROM files_ GROUP BY conversation_id"""
)
def output_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files in a folder of outputs."""
    path = scratch_path(spark, "texts")
    write_texts(T.message_files(spark, sf_dir).groupBy("conversation_id").agg(F.min("html").alias("text")), path, T.NOW_MS)
    return list_outputs(spark, path)


@query(
    r"""WITH h_ AS (SELECT page_id, md5(url) AS h FROM pages), ids_ AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]
        WHEN 1 THEN upper(h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-9' || h[18:20] || '-' || h[21:32]) WHEN 2 THEN h WHEN 3 THEN h[1:8] || '-' || h[9:12] || '-1' || h[14:16] || '-b' || h[18:20] || '-' || h[21:32] || 'x' ELSE '' END AS id FROM h_)
    SELECT page_id, regexp_full_match(id, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') AS valid FROM ids_"""
)
def job_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strings are ids of jobs."""
    h, kind = F.md5("url"), F.col("page_id") % 5
    part = lambda *p: F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), *p, F.substring(h, 21, 12))
    plain = part(F.substring(h, 13, 4), F.substring(h, 17, 4))
    four = F.upper(part(F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("9"), F.substring(h, 18, 3))))
    longer = F.concat(part(F.concat(F.lit("1"), F.substring(h, 14, 3)), F.concat(F.lit("b"), F.substring(h, 18, 3))), F.lit("x"))
    own = F.when(kind == 0, plain).when(kind == 1, four).when(kind == 2, h).when(kind == 3, longer).otherwise("")
    return T.table(spark, sf_dir, "pages").select("page_id", J.valid_job_id(own).alias("valid"))


@query(
    r"""WITH told_ AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Title: x' || chr(10) || 'Pages:   ' || page_id || chr(10) || 'poppler 22.' || page_id || '.0' WHEN 1 THEN 'Pages: none' WHEN 2 THEN 'version 1.2' ELSE 'Pages: ' || page_id || ' Pages: 7 0.1.2 3.4.5' END AS out,
        ['90,270', ' 180 , 90deg,90,x', '45,,360', '270,180,-90'][1 + page_id % 4] AS setting FROM pages)
    SELECT page_id, TRY_CAST(nullif(regexp_extract(out, 'Pages:\s+(\d+)', 1), '') AS INTEGER) AS pages, nullif(regexp_extract(out, '(\d+\.\d+\.\d+)', 1), '') AS version,
    ['90,270', '180,90', '', '270,180'][1 + page_id % 4] AS angles FROM told_"""
)
def probe_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page counts and versions in what probes print, and the quarter turns that settings name."""
    page, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    out = (
        F.when(kind == 0, F.concat(F.lit("Title: x\nPages:   "), page, F.lit("\npoppler 22."), page, F.lit(".0")))
        .when(kind == 1, "Pages: none").when(kind == 2, "version 1.2").otherwise(F.concat(F.lit("Pages: "), page, F.lit(" Pages: 7 0.1.2 3.4.5")))
    )
    setting = F.element_at(F.array(*map(F.lit, ("90,270", " 180 , 90deg,90,x", "45,,360", "270,180,-90"))), (kind + 1).cast("int"))
    return T.table(spark, sf_dir, "pages").select("page_id", pages_in_probe(out).alias("pages"), version_in_probe(out).alias("version"), F.array_join(rotation_angles(setting), ",").alias("angles"))


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{"name":"TypeError","message":"page ' || page_id || '","stack":"at ' || page_id || '"}' WHEN 1 THEN '{"name":"Error","message":"page ' || page_id || '"}'
    ELSE '{"value":"page ' || page_id || '"}' END AS json FROM pages"""
)
def errors_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, kind = F.col("page_id").cast("string"), F.col("page_id") % 3
    told = J.error_json(F.when(kind == 0, "TypeError").when(kind == 1, "Error"), F.concat(F.lit("page "), page), F.when(kind == 0, F.concat(F.lit("at "), page)))
    return T.table(spark, sf_dir, "pages").select("page_id", told.alias("json"))


def _page_texts(content: bytes) -> list[str]:
    return [t for t, _, _ in _pages_of(content)]


def _page_images(content: bytes) -> dict[int, int]:
    if content.startswith(b"E"):
        raise ValueError("no images")
    return {k: n for k, (_, n, _) in enumerate(_pages_of(content), 1) if n}


def _page_tables(content: bytes) -> dict[int, int]:
    return {k: n for k, (_, _, n) in enumerate(_pages_of(content), 1)}


@query(
    """WITH first_ AS (SELECT conv_id, starts_with(arg_min(text, turn), 'E') AS fails FROM conversations GROUP BY conv_id)
    SELECT c.conv_id AS file_id, turn + 1 AS page_number, sha256(text) AS text_sha256, CASE WHEN fails THEN 0 ELSE (length(text) - length(replace(text, 'la', ''))) // 2 END AS embedded_image_count,
    (length(text) - length(replace(text, 'en', ''))) // 2 // 5 AS table_count, max(turn + 1) OVER (PARTITION BY c.conv_id) AS total_pages, CAST(NULL AS VARCHAR) AS error FROM conversations c JOIN first_ f ON f.conv_id = c.conv_id WHERE c.conv_id % 9 <> 4
    UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, NULL, 'Erro ao extrair texto do PDF: no pages' FROM conversations WHERE conv_id % 9 = 4"""
)
def native_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages by one engine, images and tables by others under limits of their own; where counting fails there are none, and the text stands."""
    told = native_pages(_paged_files(spark, sf_dir), _page_texts, _page_images, _page_tables)
    return told.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query(
    r"""WITH told_ AS (SELECT page_id, ['List of available languages in "/t/" (3):' || chr(10) || 'eng' || chr(10) || ' por ' || chr(10) || 'osd', 'por' || chr(13) || chr(10), NULL, 'deu por' || chr(10) || 'eng x', 'eng' || chr(10) || chr(10) || 'por+eng', 'por eng'][1 + page_id % 6] AS out,
        CASE WHEN page_id % 7 = 0 THEN ' deu ' WHEN page_id % 7 = 1 THEN '  ' END AS preferred FROM pages)
    SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'deu' WHEN page_id % 6 = 0 THEN 'por+eng' ELSE 'por' END AS language, ['eng,por,osd', 'por', '', 'deu,eng', 'eng,por+eng', 'por'][1 + page_id % 6] AS listed FROM told_"""
)
def ocr_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that pages are recognised in, by what a recogniser lists and what is set."""
    page = F.col("page_id")
    told = ('List of available languages in "/t/" (3):\neng\n por \nosd', "por\r\n", None, "deu por\neng x", "eng\n\npor+eng", "por eng")
    out = F.element_at(F.array(*map(F.lit, told)), (page % 6 + 1).cast("int"))
    preferred = F.when(page % 7 == 0, " deu ").when(page % 7 == 1, "  ")
    return T.table(spark, sf_dir, "pages").select("page_id", ocr_language(out, preferred).alias("language"), F.array_join(languages_listed(out), ",").alias("listed"))
