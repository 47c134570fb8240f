"""Queries over the model's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Limits, OcrKnobs
from ..functions import quality as Q
from ..functions import text as X
from ..functions import urls as U
from ..functions.ocr_score import good_enough, ocr_score
from ..operators import jobs as J
from ..operators import messages as M
from ..operators import ocr as O
from ..operators import pages as P
from ..operators import sheets as S
from ..sources.folders import kept, scratch_path
from ..streaming.jobs import hourly_counts, run_once, table_stream
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- pieces of SQL ---------------------------------------------------------------------------------------------------


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_lit(pattern)}, {_lit(by)}, 'g')"


def _trim(x: str) -> str:
    return _sub(x, rf"\A{X.SPACE}+|{X.SPACE}+\z", "")


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_lit(pattern)}))"


def _len(x: str) -> str:
    return f"(length({x}) + {_count(x, X.ASTRAL)})"


def _sanitize(x: str) -> str:
    return f"coalesce({_trim(_sub(x, X.SPACE + '+', ' '))}, '')"


def _sanitize_text(x: str) -> str:
    for pattern, by in X.SANITIZE_STEPS:
        x = _sub(x, pattern, by)
    return f"coalesce({_trim(x)}, '')"


def _repetition(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 0.0 ELSE (len({x}) - len(list_distinct({x}))) / len({x}) END"


PAGES = "pages_ AS (SELECT conv_id AS file_id, turn + 1 AS page_number, text FROM conversations)"
FILES = "files_ AS (SELECT file_id, max(page_number) + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS total_pages FROM pages_ GROUP BY file_id)"
SPINE = """spine_ AS (
    SELECT f.file_id, g.page_number, coalesce(p.text, '') AS text,
           CASE WHEN p.text IS NOT NULL AND (f.file_id * 7 + g.page_number * 3) % 5 = 0 THEN f.file_id % 3 + 1 ELSE 0 END AS embedded_image_count,
           CASE WHEN p.text IS NOT NULL AND (f.file_id + g.page_number) % 11 = 0 THEN 1 ELSE 0 END AS table_count
    FROM files_ f JOIN (SELECT unnest(range(1, (SELECT max(total_pages) FROM files_) + 1)) AS page_number) g ON g.page_number <= f.total_pages
    LEFT JOIN pages_ p ON p.file_id = f.file_id AND p.page_number = g.page_number
)"""


def _diag(source: str, name: str = "diag_") -> str:
    """CTEs that give the diagnostics of source's text."""
    return f"""
    {name}t AS (SELECT *, {_trim("coalesce(text, '')")} AS t FROM {source}),
    {name}c AS (SELECT *, {_len("coalesce(text, '')")} AS text_length, {_len("t")} AS n, {_count("t", X.WORD)} AS words, {_count("t", X.LETTERS_DIGITS)} AS alnum,
                {_count("t", X.SPACE)} AS white, {_count("t", " ")} AS blank, contains(t, chr(65533)) AS bad,
                list_filter(list_transform(string_split(t, chr(10)), lambda l: {_trim("l")}), lambda l: l <> '') AS ls FROM {name}t),
    {name}r AS (SELECT *, {_repetition("ls")} AS rep, alnum / greatest(n, 1) AS alphanumeric_ratio, blank / greatest(n, 1) AS space_density,
                white / greatest(n, 1) AS whitespace_ratio FROM {name}c),
    {name}b AS (SELECT *, n > 0 AND NOT (n < 300 OR bad) AS usable FROM {name}r),
    {name}f AS (SELECT *, usable AND rep > 0.65 AS is_repetitive, n > 0 AND (n < 300 OR bad OR space_density > 0.45) AS has_ocr_indicators,
                usable AND alphanumeric_ratio >= 0.55 AND words >= 40 AND space_density <= 0.45 AS is_high_quality,
                usable AND n >= 500 AND words >= 40 AS has_substantial_content FROM {name}b),
    {name} AS (SELECT *, is_high_quality AND has_substantial_content AND NOT is_repetitive AS should_skip_ocr,
                CASE WHEN n = 0 THEN 0 WHEN n < 300 OR bad THEN 10 ELSE least(100, CASE WHEN is_high_quality THEN 40 ELSE 0 END + CASE WHEN has_substantial_content THEN 30 ELSE 0 END
                + CASE WHEN is_repetitive THEN 0 ELSE 20 END + CASE WHEN has_ocr_indicators THEN 0 ELSE 10 END + CASE WHEN n > 1000 AND n < 50000 THEN 10 ELSE 0 END) END AS quality_score,
                CASE WHEN n = 0 THEN 'empty' WHEN bad THEN 'corrupted-text' WHEN n < 300 THEN 'short-text' WHEN is_repetitive THEN 'repetitive-text'
                WHEN is_high_quality AND has_substantial_content THEN 'native-text' ELSE 'ocr-candidate' END AS classification FROM {name}f)"""


DECIDED = (
    _diag("spine_")
    + """,
    decided_ AS (SELECT *, embedded_image_count > 0 OR table_count > 0 AS visual FROM diag_),
    chosen_ AS (SELECT *, visual OR (NOT should_skip_ocr AND (NOT is_high_quality OR has_ocr_indicators)) AS should_ocr FROM decided_)"""
)
MIXED = f"WITH {PAGES}, {FILES}, {SPINE}, {DECIDED}"

_CONTENT, _HEADER = Q.any_of(Q.CONTENT_PATTERNS, r"\b", r"\b", "i"), Q.any_of(tuple((p, False) for p in Q.HEADER_PATTERNS), r"\b", r"\b", "i")
DOCUMENTS = f"""WITH docs_ AS (
    SELECT doc_id AS file_id, coalesce(text, '') AS text, greatest(CAST(ceil(n_chars / 1800) AS BIGINT), 1) AS total_pages,
           greatest(CAST(ceil(n_chars / 1800) AS BIGINT), 1) * (doc_id * 7919 % 90000) AS n_bytes, {_trim("coalesce(text, '')")} AS t FROM documents
), lines_ AS (
    SELECT *, {_len("text")} AS text_length, {_len("t")} AS n, list_filter(string_split(t, chr(10)), lambda l: {_len(_trim("l"))} > 5) AS ls FROM docs_
), counted_ AS (
    SELECT *, len(ls) AS line_count, len(list_filter(ls, lambda l: regexp_matches(l, {_lit(_CONTENT)}))) AS content_lines,
           len(list_filter(ls, lambda l: regexp_matches(l, {_lit(_HEADER)}))) AS header_lines, list_transform(ls, lambda l: {_trim("l")}) AS trimmed,
           {_count("t", X.LETTERS_DIGITS)} AS alphanumeric_count, {_count("t", " ")} AS space_count,
           {_count("t", chr(92) + "b" + X.FRAGMENTS)} AS fragmented_words, {_count("t", chr(92) + "b" + X.LONE_DIGIT + chr(92) + "b")} AS isolated_digits FROM lines_
), rated_ AS (
    SELECT *, {_repetition("trimmed")} AS line_repetition, n > 0 AND text_length >= 2000 AND NOT contains(t, chr(65533)) AND line_count >= 3 AS whole FROM counted_
), flags_ AS (
    SELECT *, whole AND line_repetition > 0.6 AS is_repetitive, whole AND alphanumeric_count / greatest(n, 1) > 0.6 AS is_high_quality,
           n > 0 AND (NOT whole OR fragmented_words > 10 OR isolated_digits > 20 OR space_count / greatest(n, 1) > 0.4) AS has_ocr_indicators,
           whole AND content_lines >= 3 AND header_lines / greatest(line_count, 1) <= 0.4 AS has_substantial_content FROM rated_
), quality_ AS (
    SELECT *, NOT is_repetitive AND NOT has_ocr_indicators AND is_high_quality AND has_substantial_content AS should_skip_ocr,
           CASE WHEN n = 0 THEN 0 WHEN text_length < 2000 THEN 10 ELSE least(100, CASE WHEN is_high_quality THEN 40 ELSE 0 END + CASE WHEN has_substantial_content THEN 30 ELSE 0 END
           + CASE WHEN is_repetitive THEN 0 ELSE 20 END + CASE WHEN has_ocr_indicators THEN 0 ELSE 10 END + CASE WHEN text_length > 1000 AND text_length < 50000 THEN 10 ELSE 0 END) END AS quality_score
    FROM flags_
), bypass_ AS (
    SELECT *, text_length / total_pages AS chars_per_page, text_length / total_pages >= CASE WHEN total_pages <= 1 THEN 300 WHEN total_pages = 2 THEN 650 ELSE 900 END AS enough FROM quality_
), bypassed_ AS (
    SELECT *, is_high_quality AND has_substantial_content AND NOT is_repetitive AND enough AND text_length >= 8000 AS strong FROM bypass_
)"""


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_sanitize('text')} AS clean FROM documents")
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(T.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {_sanitize_text('text')} AS clean FROM documents")
def sanitize_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(T.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.sanitize_text(F.col("text")).alias("clean"))


@query(f"SELECT page_id, {_sanitize_text('html')} AS clean FROM pages")
def sanitize_text_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(T.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", X.sanitize_text(F.col("html")).alias("clean"))


@query(f"SELECT page_id, CAST({_len('html')} - {_len(_sanitize_text('html'))} AS BIGINT) AS removed_chars FROM pages WHERE {_len('html')} - {_len(_sanitize_text('html'))} > 100")
def sidecar_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which sanitizing removes more than 100 characters get a side file."""
    p = T.spread(T.table(spark, sf_dir, "pages").select("page_id", "html"))
    # a filter on the number would sanitize once for the filter and again for the number; in an array it is worked out once
    removed = F.transform(F.array(X.sanitize_text(F.col("html"))), lambda x: X.js_length(F.col("html")) - X.js_length(x))
    return p.select("page_id", F.explode(F.filter(removed, lambda n: n > 100)).alias("removed_chars"))


@query(f"SELECT conv_id, turn, upper({_trim('text')}) = 'TEXTO' AS redundant FROM conversations")
def redundant_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_redundant_sidecar(F.col("text")).alias("redundant"))


# --- pages -----------------------------------------------------------------------------------------------------------


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_page_diagnostics(T.native_pages(spark, sf_dir))


@query(
    f"WITH {PAGES}, {_diag('pages_')} SELECT file_id, page_number, CAST(text_length AS BIGINT) AS text_length, CAST(n AS BIGINT) AS trimmed_length, CAST(words AS BIGINT) AS word_count, "
    "alphanumeric_ratio, whitespace_ratio, space_density, CAST(rep AS DOUBLE) AS repetition_ratio FROM diag_"
)
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagnosed(spark, sf_dir)
    return d.select("file_id", "page_number", *[F.col(f"diag.{c}") for c in ("text_length", "trimmed_length", "word_count", "alphanumeric_ratio", "whitespace_ratio", "space_density", "repetition_ratio")])


@query(f"WITH {PAGES}, {_diag('pages_')} SELECT file_id, page_number, classification, should_skip_ocr, is_high_quality, is_repetitive, has_ocr_indicators, has_substantial_content FROM diag_")
def page_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagnosed(spark, sf_dir)
    return d.select("file_id", "page_number", *[F.col(f"diag.{c}") for c in ("classification", "should_skip_ocr", "is_high_quality", "is_repetitive", "has_ocr_indicators", "has_substantial_content")])


@query(f"WITH {PAGES}, {_diag('pages_')} SELECT file_id, page_number, quality_score FROM diag_")
def page_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).select("file_id", "page_number", "diag.quality_score")


@query(
    f"WITH {PAGES}, {_diag('pages_')} SELECT file_id, "
    + ", ".join(f"count(*) FILTER (classification = '{c}') AS n_{c.replace('-', '_')}" for c in Q.PAGE_CLASSES)
    + " FROM diag_ GROUP BY file_id"
)
def page_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_histogram(_diagnosed(spark, sf_dir), "file_id")


def _document_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Q.with_page_diagnostics(T.spread(docs))


@query(
    f"WITH {_diag('documents')} SELECT source, "
    + ", ".join(f"count(*) FILTER (classification = '{c}') AS n_{c.replace('-', '_')}" for c in Q.PAGE_CLASSES)
    + " FROM diag_ GROUP BY source"
)
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of whole documents, each taken as a page, by source."""
    return P.page_histogram(_document_diagnosed(spark, sf_dir), "source")


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_spine(T.pdf_files(spark, sf_dir), T.native_pages(spark, sf_dir))


@query(f"WITH {PAGES}, {FILES}, {SPINE} SELECT file_id, page_number, text FROM spine_")
def page_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spine(spark, sf_dir).select("file_id", "page_number", "text")


def _visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_visuals(_spine(spark, sf_dir), T.image_counts(spark, sf_dir), T.table_counts(spark, sf_dir))


@query(f"WITH {PAGES}, {FILES}, {SPINE} SELECT file_id, page_number, embedded_image_count, CAST(table_count AS BIGINT) AS table_count, embedded_image_count > 0 OR table_count > 0 AS has_visual_content FROM spine_")
def visual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visual(spark, sf_dir).select("file_id", "page_number", "embedded_image_count", "table_count", "has_visual_content")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.with_page_diagnostics(_visual(spark, sf_dir))
    visual = F.col("has_visual_content")
    return d.withColumns({"should_ocr": P.should_ocr(F.col("diag"), visual), "reason": P.ocr_reason(F.col("diag"), visual)})


@query(
    MIXED
    + """ SELECT file_id, page_number, should_ocr, CASE WHEN visual THEN 'visual-content' WHEN should_ocr AND has_ocr_indicators THEN 'ocr-indicators'
    WHEN should_ocr THEN 'insufficient-native-text' WHEN should_skip_ocr THEN 'quality-analysis-skip' ELSE 'native-text-sufficient' END AS reason FROM chosen_"""
)
def page_ocr_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("file_id", "page_number", "should_ocr", "reason")


@query(
    MIXED
    + """ SELECT file_id, count(*) AS total_pages, count(*) FILTER (should_ocr) AS ocr_pages, count(*) FILTER (NOT should_ocr) AS native_pages, count(*) FILTER (visual) AS visual_pages,
    count(*) FILTER (embedded_image_count > 0) AS pages_with_images, count(*) FILTER (table_count > 0) AS pages_with_tables FROM chosen_ GROUP BY file_id"""
)
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_counts(_decided(spark, sf_dir), "file_id")


_CHUNKS = """, runs_ AS (SELECT file_id, page_number, page_number - row_number() OVER (PARTITION BY file_id ORDER BY page_number) AS island FROM chosen_ WHERE should_ocr),
    buckets_ AS (SELECT *, (page_number - min(page_number) OVER (PARTITION BY file_id, island)) // 2 AS bucket FROM runs_),
    chunks_ AS (SELECT file_id, min(page_number) AS first, max(page_number) AS last FROM buckets_ GROUP BY file_id, island, bucket)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.selected_chunks(_decided(spark, sf_dir).where("should_ocr"))


@query(MIXED + _CHUNKS + " SELECT file_id, first, last FROM chunks_")
def selected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query(MIXED + _CHUNKS + " SELECT file_id, first, last, CAST(unnest(range(0, last - first + 1)) AS INTEGER) AS ordinal, unnest(range(first, last + 1)) AS page_number FROM chunks_")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_pages(_chunks(spark, sf_dir))


@query(
    """WITH d AS (SELECT doc_id AS file_id, greatest(CAST(ceil(n_chars / 1800) AS BIGINT), 1) AS total FROM documents),
    s AS (SELECT *, least(greatest(CAST(ceil(total / 8) AS BIGINT), 1), 50) AS size FROM d), i AS (SELECT *, unnest(range(0, total, size)) AS i FROM s)
    SELECT file_id, i + 1 AS first, least(i + size, total) AS last FROM i"""
)
def full_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.full_chunks(T.native_documents(spark, sf_dir).select("file_id", "total_pages"), workers=4)


@query(
    """WITH d AS (SELECT doc_id AS file_id, greatest(CAST(ceil(n_chars / 1800) AS BIGINT), 1) AS total_pages FROM documents)
    SELECT file_id, total_pages, CASE WHEN total_pages > 5 THEN 'PDF possui ' || total_pages || ' páginas, acima do limite configurado de 5.' END AS error FROM d"""
)
def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.native_documents(spark, sf_dir).select("file_id", "total_pages", P.page_limit_error(F.col("total_pages"), 5).alias("error"))


@query(
    DOCUMENTS
    + " SELECT file_id, total_pages <= 10 AND n / total_pages < 80 AS direct_ocr FROM lines_"
)
def direct_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.native_documents(spark, sf_dir).select("file_id", P.direct_ocr(F.col("total_pages"), F.coalesce("text", F.lit(""))).alias("direct_ocr"))


_OCR_TEXT = """, ocr_ AS (SELECT p.file_id, p.page_number, CASE WHEN (p.file_id + p.page_number) % 6 = 0 THEN ' ' || chr(10) || ' ' ELSE coalesce(b.text, '') END AS ocr_text
    FROM pages_ p LEFT JOIN benchmark b ON b.item_id = (p.file_id * 8 + p.page_number - 1) % (SELECT max(item_id) + 1 FROM benchmark))"""
_OVERLAY = (
    _OCR_TEXT
    + f""", overlay_ AS (SELECT c.file_id, c.page_number, c.should_ocr, coalesce(CASE WHEN c.should_ocr THEN nullif({_trim("o.ocr_text")}, '') END, c.text) AS merged, c.text
    FROM chosen_ c LEFT JOIN ocr_ o ON c.file_id = o.file_id AND c.page_number = o.page_number)"""
)


def _overlaid(spark: SparkSession, sf_dir: str, decided: DataFrame | None = None) -> DataFrame:
    pages = _decided(spark, sf_dir) if decided is None else decided
    # the recogniser is asked for selected pages alone
    ocr = T.ocr_texts(spark, sf_dir).join(pages.where("should_ocr").select("file_id", "page_number"), ["file_id", "page_number"], "left_semi")
    return P.ocr_overlay(pages, ocr)


@query(MIXED + _OVERLAY + " SELECT file_id, page_number, should_ocr, merged AS text FROM overlay_")
def ocr_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaid(spark, sf_dir).select("file_id", "page_number", "should_ocr", "text")


@query(f"WITH {PAGES} SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER ({_trim('text')} <> '') AS text FROM pages_ GROUP BY file_id")
def merged_conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ordered_text(T.native_pages(spark, sf_dir), ["file_id"], "page_number", "text", "\n\n")


_BUDGET = """, requests_ AS (SELECT file_id // 10 AS job_id, file_id AS file_order, count(*) FILTER (should_ocr) AS ocr_pages FROM chosen_ GROUP BY file_id),
    numbered_ AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY file_order) AS k FROM requests_),
    fold_ AS (
        SELECT job_id, file_order, ocr_pages, k, ocr_pages <= 20 AS accepted, CASE WHEN ocr_pages <= 20 THEN ocr_pages ELSE 0 END AS used FROM numbered_ WHERE k = 1
        UNION ALL
        SELECT n.job_id, n.file_order, n.ocr_pages, n.k, f.used + n.ocr_pages <= 20, f.used + CASE WHEN f.used + n.ocr_pages <= 20 THEN n.ocr_pages ELSE 0 END
        FROM fold_ f JOIN numbered_ n ON n.job_id = f.job_id AND n.k = f.k + 1
    )"""


def _budget(spark: SparkSession, sf_dir: str, decided: DataFrame | None = None) -> DataFrame:
    counts = P.page_counts(_decided(spark, sf_dir) if decided is None else decided, "file_id")
    requests = counts.select(F.floor(F.col("file_id") / 10).alias("job_id"), F.col("file_id").alias("file_order"), "ocr_pages")
    return P.reserve_pages(requests, 20)


@query(MIXED.replace("WITH ", "WITH RECURSIVE ", 1) + _BUDGET + " SELECT job_id, file_order, ocr_pages, accepted, greatest(20 - used, 0) AS remaining FROM fold_")
def ocr_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir)


@query(
    MIXED.replace("WITH ", "WITH RECURSIVE ", 1)
    + _OVERLAY
    + _BUDGET
    + f""", counts_ AS (SELECT file_id, count(*) AS total_pages, count(*) FILTER (should_ocr) AS ocr_pages FROM chosen_ GROUP BY file_id),
    native_ AS (SELECT file_id, sum({_len(_trim('text'))}) AS chars FROM pages_ GROUP BY file_id),
    merged_ AS (SELECT file_id, string_agg(merged, chr(10) || chr(10) ORDER BY page_number) FILTER ({_trim('merged')} <> '') AS text FROM overlay_ GROUP BY file_id)
    SELECT c.file_id, c.total_pages, c.ocr_pages,
           CASE WHEN c.total_pages > 7 THEN 'PDF possui ' || c.total_pages || ' páginas, acima do limite configurado de 7.'
                WHEN NOT f.accepted THEN 'PDF requer OCR em ' || c.ocr_pages || ' páginas, mas restam ' || greatest(20 - f.used, 0) || ' páginas de OCR no limite deste job.' END AS error,
           CASE WHEN c.total_pages <= 7 AND f.accepted THEN {_sanitize('m.text')} END AS text
    FROM counts_ c JOIN fold_ f ON f.file_order = c.file_id JOIN merged_ m ON m.file_id = c.file_id"""
)
def mixed_page_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow page by page: spine, diagnostics, choice of pages, budget of a job, overlay and merged text, or the error. What is decided of pages
    is computed once and kept."""
    decided = kept(_decided(spark, sf_dir).select("file_id", "page_number", "text", "should_ocr", "has_visual_content", "embedded_image_count", "table_count"))
    counts = P.page_counts(decided, "file_id").select("file_id", "total_pages", "ocr_pages")
    budget = _budget(spark, sf_dir, decided).select(F.col("file_order").alias("file_id"), "accepted", "remaining")
    merged = P.ordered_text(_overlaid(spark, sf_dir, decided), ["file_id"], "page_number", "text", "\n\n")
    error = F.coalesce(P.page_limit_error(F.col("total_pages"), 7), P.budget_error(F.col("ocr_pages"), F.col("remaining"), F.col("accepted")))
    told = counts.join(budget, "file_id").join(merged, "file_id").withColumn("error", error)
    return told.select("file_id", "total_pages", "ocr_pages", "error", F.when(F.col("error").isNull(), X.sanitize(F.col("text"))).alias("text"))


@query(
    MIXED
    + _OCR_TEXT
    + f""", r_ AS (SELECT p.file_id, p.page_number, p.text, o.ocr_text, CASE WHEN p.page_number % 3 = 0 THEN 'ocr' END AS err FROM pages_ p JOIN ocr_ o ON p.file_id = o.file_id AND p.page_number = o.page_number)
    SELECT file_id, page_number, CASE WHEN err IS NOT NULL THEN CASE WHEN {_trim('text')} <> '' THEN {_sanitize('text')} END WHEN {_trim('ocr_text')} = '' AND {_trim('text')} <> '' THEN {_sanitize('text')}
    ELSE {_sanitize('ocr_text')} END AS value, CASE WHEN err IS NOT NULL AND {_trim('text')} = '' THEN err END AS error FROM r_"""
)
def ocr_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.native_pages(spark, sf_dir).join(T.ocr_texts(spark, sf_dir), ["file_id", "page_number"])
    error = F.when(F.col("page_number") % 3 == 0, "ocr")
    return pages.withColumn("r", P.ocr_fallback(F.col("text"), F.col("ocr_text"), error)).select("file_id", "page_number", "r.value", "r.error")


@query(
    MIXED
    + """, counts_ AS (SELECT file_id, count(*) FILTER (should_ocr) AS ocr_pages FROM chosen_ GROUP BY file_id)
    SELECT file_id, ocr_pages, CASE WHEN ocr_pages > 3 THEN 'PDF requer OCR em ' || ocr_pages || ' páginas, acima do limite configurado de 3.' END AS error FROM counts_"""
)
def pages_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of pages that OCR may take of one file."""
    counts = P.page_counts(_decided(spark, sf_dir), "file_id").select("file_id", "ocr_pages")
    return counts.withColumn("error", P.pages_limit_error(F.col("ocr_pages"), 3))


@query(
    MIXED
    + """, probes_ AS (SELECT file_id, file_id % 7 <> 3 AS valid, greatest(total_pages - file_id % 2, 0) AS page_count FROM files_)
    SELECT c.file_id, c.page_number FROM chosen_ c JOIN probes_ p ON p.file_id = c.file_id WHERE c.should_ocr AND p.valid AND c.page_number <= p.page_count"""
)
def probed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected pages that the probe of their file knows of."""
    files = T.pdf_files(spark, sf_dir)
    probes = files.select("file_id", (F.col("file_id") % 7 != 3).alias("valid"), F.greatest(F.col("total_pages") - F.col("file_id") % 2, F.lit(0)).alias("page_count"))
    return P.probed_pages(_decided(spark, sf_dir).where("should_ocr").select("file_id", "page_number"), probes)


@query(
    MIXED
    + _OVERLAY
    + f""", native_ AS (SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER ({_trim('text')} <> '') AS text FROM pages_ GROUP BY file_id),
    merged_ AS (SELECT file_id, count(*) FILTER (should_ocr) > 0 AND file_id % 3 = 1 AS failed, string_agg(merged, chr(10) || chr(10) ORDER BY page_number) FILTER ({_trim('merged')} <> '') AS text FROM overlay_ GROUP BY file_id),
    ladder_ AS (SELECT m.file_id, m.failed, coalesce(n.text, '') AS native, m.text AS merged FROM merged_ m LEFT JOIN native_ n ON n.file_id = m.file_id)
    SELECT file_id, CASE WHEN NOT failed THEN {_sanitize('merged')} WHEN {_trim('native')} <> '' THEN {_sanitize(_trim('native'))} END AS value, CASE WHEN failed AND {_trim('native')} = '' THEN 'ocr' END AS error FROM ladder_"""
)
def mixed_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which OCR fails on a third: their whole native text stands, if there is any."""
    native = P.ordered_text(T.native_pages(spark, sf_dir), ["file_id"], "page_number", "text", "\n\n").withColumnRenamed("text", "native")
    merged = P.ordered_text(_overlaid(spark, sf_dir), ["file_id"], "page_number", "text", "\n\n")
    counts = P.page_counts(_decided(spark, sf_dir), "file_id").select("file_id", "ocr_pages")
    told = merged.join(counts, "file_id").join(native, "file_id", "left")
    result = P.mixed_result(F.coalesce("native", F.lit("")), F.col("text"), F.col("ocr_pages"), F.when(F.col("file_id") % 3 == 1, "ocr"))
    return told.withColumn("r", result).select("file_id", "r.value", "r.error")


# --- whole documents -------------------------------------------------------------------------------------------------


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_document_analysis(T.native_documents(spark, sf_dir))


@query(DOCUMENTS + " SELECT file_id, should_skip_ocr, is_high_quality, is_repetitive, has_ocr_indicators, has_substantial_content, quality_score FROM quality_")
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("should_skip_ocr", "is_high_quality", "is_repetitive", "has_ocr_indicators", "has_substantial_content", "quality_score")
    return _analysed(spark, sf_dir).select("file_id", *[F.col(f"quality.{c}") for c in names])


@query(DOCUMENTS + " SELECT file_id, line_count, CAST(line_repetition AS DOUBLE) AS line_repetition FROM rated_")
def doc_line_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("file_id", "quality.line_count", "quality.line_repetition")


@query(DOCUMENTS + " SELECT file_id, content_lines, header_lines FROM counted_")
def doc_header_content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("file_id", "quality.content_lines", "quality.header_lines")


@query(DOCUMENTS + " SELECT file_id, alphanumeric_count, space_count FROM counted_")
def doc_char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("file_id", "quality.alphanumeric_count", "quality.space_count")


@query(DOCUMENTS + " SELECT file_id, fragmented_words, isolated_digits FROM counted_")
def doc_ocr_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("file_id", "quality.fragmented_words", "quality.isolated_digits")


@query(DOCUMENTS + " SELECT file_id, chars_per_page, strong, strong OR (should_skip_ocr AND enough) AS skip FROM bypassed_")
def ocr_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Q.ocr_bypass(F.col("quality"), F.col("total_pages"))
    return _analysed(spark, sf_dir).withColumn("b", b).select("file_id", "b.chars_per_page", "b.strong", "b.skip")


@query(
    DOCUMENTS
    + """, reasons_ AS (SELECT file_id, CASE WHEN total_pages = 0 THEN 'no-pages' WHEN total_pages <= 5 THEN 'always-ocr' WHEN NOT (strong OR (should_skip_ocr AND enough)) THEN 'insufficient-text'
    WHEN strong AND has_ocr_indicators THEN CASE WHEN n_bytes / total_pages > 50000 THEN 'looks-scanned' ELSE 'filesize-validated' END WHEN strong THEN 'strong-direct-text' ELSE 'quality-analysis' END AS reason FROM bypassed_)
    SELECT file_id, CASE WHEN reason IN ('always-ocr', 'insufficient-text', 'looks-scanned') THEN 'ocr' ELSE 'native' END AS decision, reason FROM reasons_"""
)
def legacy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.legacy_decision(F.col("quality"), F.col("total_pages"), F.col("n_bytes"))
    return _analysed(spark, sf_dir).withColumn("d", d).select("file_id", "d.decision", "d.reason")


# --- OCR attempts ----------------------------------------------------------------------------------------------------

_ATTEMPTS = """WITH attempts_ AS (SELECT l_orderkey AS page, l_linenumber AS attempt, max(l_quantity) * 2 AS confidence, max(l_partkey) % 200 AS words, max(l_suppkey) * 37 % 900 AS chars
    FROM lineitem GROUP BY l_orderkey, l_linenumber),
    scored_ AS (SELECT *, least(greatest(confidence, 0), 100) + least(chars / 120, 35) + least(12 * log10(words + 1), 25) * 1.2::DOUBLE AS score,
    confidence >= 78 AND words >= 30 AND chars >= 300 AS good FROM attempts_)"""


@query(_ATTEMPTS + " SELECT page, attempt, round(score, 6) AS score, good FROM scored_")
def ocr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = (F.col("confidence"), F.col("words"), F.col("chars"))
    return T.attempts(spark, sf_dir).select("page", "attempt", F.round(ocr_score(*cells), 6).alias("score"), good_enough(*cells).alias("good"))


@query(
    _ATTEMPTS
    + """, upto_ AS (SELECT *, min(CASE WHEN good THEN attempt END) OVER (PARTITION BY page) AS stop FROM scored_ WHERE attempt <= 3),
    ranked_ AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN attempt = stop THEN 0 ELSE 1 END, score DESC, attempt) AS k FROM upto_)
    SELECT page, attempt, round(score, 6) AS score, confidence, words, chars, good FROM ranked_ WHERE k = 1"""
)
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.best_attempt(T.attempts(spark, sf_dir), ["page"], OcrKnobs(max_attempts=3)).withColumn("score", F.round("score", 6))


@query(
    _ATTEMPTS
    + """, base_ AS (SELECT *, NOT good AND (words <= 5 OR confidence <= 50 OR chars <= 30) AS eligible FROM scored_ WHERE attempt = 1),
    turned_ AS (SELECT page, CASE WHEN attempt = 3 THEN 90 ELSE 270 END AS angle, words, score FROM scored_ WHERE attempt IN (3, 4)),
    ranked_ AS (SELECT b.page, t.angle, t.score, row_number() OVER (PARTITION BY b.page ORDER BY t.score DESC, t.angle) AS k FROM base_ b JOIN turned_ t ON t.page = b.page
        WHERE b.eligible AND t.words >= 10 AND t.score - b.score >= 8)
    SELECT b.page, coalesce(r.angle, 0) AS angle, round(coalesce(r.score, b.score), 6) AS score FROM base_ b LEFT JOIN ranked_ r ON r.page = b.page AND r.k = 1"""
)
def rotation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = T.attempts(spark, sf_dir).where("attempt = 1").drop("attempt")
    knobs = OcrKnobs(rotate=True, rotate_max_attempts=2)
    return O.rotation_choice(best, T.rotations(spark, sf_dir), ["page"], [90, 270], knobs).withColumn("score", F.round("score", 6))


@query(
    f"""WITH lines_ AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k,
    [CASE WHEN l_quantity > 45 THEN '4' ELSE '5' END, '1', CAST(l_partkey % 2 AS VARCHAR), '1', CAST(l_suppkey % 3 AS VARCHAR),
     CASE WHEN l_returnflag = 'R' THEN '-1' ELSE CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) END, CASE WHEN l_linestatus = 'F' THEN 'w' || l_partkey ELSE ' ' || l_returnflag END] AS c, l_partkey FROM lineitem),
    words_ AS (SELECT page_id, k, c[2] || '.' || c[3] || '.' || c[4] || '.' || c[5] AS key, CAST(c[6] AS DOUBLE) AS conf, {_trim("c[7]")} AS word FROM lines_ WHERE l_partkey % 13 <> 0 AND c[1] = '5'),
    turns_ AS (SELECT *, CASE WHEN lag(key) OVER w <> key THEN 1 ELSE 0 END AS turn FROM words_ WINDOW w AS (PARTITION BY page_id ORDER BY k)),
    numbered_ AS (SELECT *, sum(turn) OVER (PARTITION BY page_id ORDER BY k) AS n FROM turns_),
    joined_ AS (SELECT page_id, n, string_agg(word, ' ' ORDER BY k) AS text, sum(CASE WHEN conf >= 0 THEN conf END) AS s, count(CASE WHEN conf >= 0 THEN 1 END) AS m, count(*) AS words FROM numbered_ GROUP BY page_id, n)
    SELECT page_id, string_agg(text, chr(10) ORDER BY n) AS text, coalesce(sum(s) / nullif(sum(m), 0), 0.0) AS mean_confidence, CAST(sum(words) AS BIGINT) AS word_count FROM joined_ GROUP BY page_id"""
)
def tsv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tsv_text(O.tsv_words(T.tsv_lines(spark, sf_dir)), ["page_id"], "k")


# --- spreadsheets ----------------------------------------------------------------------------------------------------

_SHEETS = """WITH rows_ AS (SELECT c_custkey // 1000 AS file_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS sheet_index,
    c_mktsegment AS sheet, c_custkey AS row_index, c_custkey % 7 <> 0 AS filled, c_name || chr(9) || c_custkey || chr(9) AS line FROM customer),
    sheets_ AS (SELECT file_id, sheet_index, sheet, coalesce(string_agg(line, chr(10) ORDER BY row_index) FILTER (filled), '') AS text, count(*) FILTER (filled) AS n_rows, count(*) FILTER (filled) * 3 AS n_cells
    FROM rows_ GROUP BY ALL)"""


@query(_SHEETS + " SELECT file_id, sheet_index, sheet, text, n_rows, n_cells FROM sheets_")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sheet_texts(T.sheet_rows(spark, sf_dir))


@query(
    _SHEETS
    + """, numbered_ AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sheet_index) AS k FROM sheets_),
    books_ AS (SELECT file_id, count(*) AS sheet_count, CAST(sum(n_cells) AS BIGINT) AS total_cells, 'Planilha Excel com ' || count(*) || ' aba(s): ' || string_agg(sheet, ', ' ORDER BY k) AS summary,
    string_agg('=== ABA ' || k || ': ' || sheet || ' ===' || chr(10) || text || chr(10) || chr(10), '' ORDER BY k) AS body FROM numbered_ GROUP BY file_id)
    SELECT file_id, sheet_count, total_cells, summary, '=== ARQUIVO EXCEL ===' || chr(10) || 'Resumo: ' || summary || chr(10) || 'Total de abas: ' || sheet_count || chr(10) || 'Total de células: ' || total_cells
    || chr(10) || chr(10) || body AS text FROM books_"""
)
def sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.workbook_texts(S.sheet_texts(T.sheet_rows(spark, sf_dir)))


# --- messages and files ----------------------------------------------------------------------------------------------

_URL_PARTS = f"regexp_extract(url, {_lit(U.URL)}, ['scheme', 'login', 'host', 'port', 'path', 'query', 'fragment'])"
_REDACTED = """CASE WHEN u.scheme = '' THEN '[invalid-url]' WHEN length(u.query) <= 1
    THEN lower(u.scheme) || '://' || CASE WHEN u.login = '' THEN '' ELSE u.login || '@' END || lower(u.host) || port || path || CASE WHEN u.query = '?' THEN '?' ELSE '' END || u.fragment
    ELSE lower(u.scheme) || '://' || lower(u.host) || port || path || '?[redacted-query]' || u.fragment END"""


def _urls(source: str) -> str:
    return f"""parts_ AS (SELECT *, {_URL_PARTS} AS u FROM {source}),
    urls_ AS (SELECT *, CASE WHEN u.port = '' OR (lower(u.scheme) = 'http' AND u.port = '80') OR (lower(u.scheme) = 'https' AND u.port = '443') THEN '' ELSE ':' || u.port END AS port,
    CASE WHEN u.path = '' THEN '/' ELSE replace(u.path, ' ', '%20') END AS path FROM parts_)"""


_MIME_LIST = "[" + ", ".join(_lit(m) for m in T.MIMES) + "]"
_FILES = f"""files_ AS (SELECT 'c' || (page_id // 8) AS conversation_id, CAST(page_id % 8 // 4 AS INTEGER) AS message_index, CAST(page_id % 4 AS INTEGER) AS file_index, 'f' || page_id AS file_id, url,
    {_MIME_LIST}[1 + page_id % {len(T.MIMES)}] AS mime_type, html, page_id FROM pages)"""
_ROUTED = f"""routed_ AS (SELECT *, CASE WHEN contains(mime_type, '/') THEN split_part(mime_type, '/', 2) ELSE 'undefined' END AS key FROM files_),
    typed_ AS (SELECT *, CASE WHEN starts_with(mime_type, 'audio/') THEN 'audio' {" ".join(f"WHEN key = {_lit(k)} THEN {_lit(v)}" for k, v in M.ROUTES.items())} END AS extractor FROM routed_)"""


@query(f"WITH {_FILES}, {_ROUTED} SELECT file_id, extractor, CASE WHEN extractor IS NULL THEN 'Unsupported file type: ' || key END AS error FROM typed_")
def mime_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.message_files(spark, sf_dir).withColumn("r", M.route(F.col("mime_type"))).select("file_id", "r.extractor", "r.error")


@query(f"WITH {_urls('pages')} SELECT page_id, regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$') AS name FROM urls_")
def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", U.basename(F.col("url")).alias("name"))


_ODD = f"odd_ AS (SELECT page_id, CASE page_id % 8 {' '.join(f'WHEN {k} THEN ' + v for k, v in T.ODD_URLS_SQL.items())} ELSE url END AS url FROM pages)"


def _by_bytes(x: str, kinds: str) -> str:
    """Characters of some kinds by their bytes."""
    return f"list_aggregate(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN regexp_matches(c, {_lit(kinds)}) THEN regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') ELSE c END), 'string_agg', '')"


_KIND = "replace(lower(s[1]), '%2e', '.')"
_DOTLESS = f"""'/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(range(1, len(parts) + 1), lambda i: [parts[i], CASE WHEN i = len(parts) THEN 'last' ELSE '' END])),
    lambda acc, s: CASE WHEN {_KIND} = '..' THEN acc[:-2] || CASE WHEN s[2] = 'last' THEN [''] ELSE [] END WHEN {_KIND} = '.' THEN acc || CASE WHEN s[2] = 'last' THEN [''] ELSE [] END ELSE acc || [s[1]] END), '/')"""
#: Punycode of each label, one column after another: code points, those beyond ASCII in order, their distances, the thresholds' bias, the digits.
_HOSTS = f"""labels_ AS (SELECT page_id, unnest(string_split(regexp_replace(lower(u.host), '[。．｡]', '.', 'g'), '.')) AS label, unnest(range(len(string_split(regexp_replace(lower(u.host), '[。．｡]', '.', 'g'), '.')))) AS k FROM split_),
    points_ AS (SELECT page_id, k, label, list_transform(range(1, length(label) + 1), lambda i: {{'c': unicode(label[i]), 'p': i}}) AS cps FROM labels_),
    beyond_ AS (SELECT *, list_sort(list_filter(cps, lambda x: x.c >= 128)) AS rest, len(list_filter(cps, lambda x: x.c < 128)) AS n, array_to_string(list_transform(list_filter(cps, lambda x: x.c < 128), lambda x: chr(x.c)), '') AS plain FROM points_),
    placed_ AS (SELECT *, list_transform(rest, lambda x: len(list_filter(cps, lambda y: y.p < x.p AND y.c <= x.c))) AS place FROM beyond_),
    deltas_ AS (SELECT *, list_transform(range(1, len(rest) + 1), lambda i: CAST((rest[i].c - CASE WHEN i = 1 THEN 128 ELSE rest[i - 1].c END) * (n + i) + place[i] - CASE WHEN i = 1 THEN 0 ELSE place[i - 1] + 1 END AS BIGINT)) AS d FROM placed_),
    halved_ AS (SELECT *, list_transform(range(1, len(d)), lambda i: d[i] // (CASE WHEN i = 1 THEN 700 ELSE 2 END) + d[i] // (CASE WHEN i = 1 THEN 700 ELSE 2 END) // (n + i)) AS e FROM deltas_),
    biased_ AS (SELECT *, list_prepend(72, list_transform(e, lambda x: CASE WHEN x <= 455 THEN 36 * x // (x + 38) WHEN x // 35 <= 455 THEN 36 + 36 * (x // 35) // (x // 35 + 38) ELSE 72 + 36 * (x // 1225) // (x // 1225 + 38) END)) AS bias FROM halved_),
    numbers_ AS (SELECT *, list_transform(range(1, len(d) + 1), lambda i: list_reduce(list_prepend([d[i]], list_transform(range(1, 10), lambda k: [least(greatest(36 * k - bias[i], 1), 26)])),
        lambda s, t: CASE WHEN s[1] < 0 THEN s WHEN s[1] < t[1] THEN [-1] || s[2:] || [s[1]] ELSE [(s[1] - t[1]) // (36 - t[1])] || s[2:] || [t[1] + (s[1] - t[1]) % (36 - t[1])] END)[2:]) AS digits FROM biased_),
    hosts_ AS (SELECT page_id, string_agg(CASE WHEN len(rest) = 0 THEN label ELSE 'xn--' || plain || CASE WHEN n > 0 THEN '-' ELSE '' END
        || array_to_string(list_transform(flatten(digits), lambda x: substr({_lit(U.DIGITS)}, CAST(x + 1 AS BIGINT), 1)), '') END, '.' ORDER BY k) AS host FROM numbers_ GROUP BY page_id)"""


@query(
    f"""WITH {_ODD}, split_ AS (SELECT page_id, {_URL_PARTS} AS u FROM odd_), {_HOSTS},
    paths_ AS (SELECT page_id, string_split(replace(u.path, chr(92), '/'), '/')[2:] AS parts, u FROM split_),
    told_ AS (SELECT p.page_id, lower(u.scheme) AS scheme, h.host || CASE WHEN ltrim(u.port, '0') IN ('', CASE lower(u.scheme) WHEN 'http' THEN '80' WHEN 'https' THEN '443' END) THEN '' ELSE ':' || ltrim(u.port, '0') END AS host,
        CASE WHEN u.path = '' THEN '/' ELSE {_by_bytes(_DOTLESS, U.IN_PATH)} END AS path, CASE WHEN u.fragment = '' THEN '' ELSE {_by_bytes('u.fragment', U.IN_FRAGMENT)} END AS fragment,
        CASE WHEN u.login = '' THEN '' ELSE {_by_bytes('split_part(u.login, chr(58), 1)', U.IN_LOGIN)} || coalesce(':' || nullif({_by_bytes("split_part(u.login, chr(58), 2)", U.IN_LOGIN)}, ''), '') || '@' END AS login, u.query AS query
        FROM paths_ p JOIN hosts_ h ON h.page_id = p.page_id)
    SELECT page_id, CASE WHEN scheme = '' THEN '[invalid-url]' WHEN length(query) <= 1 THEN scheme || '://' || login || host || path || CASE WHEN query = '?' THEN '?' ELSE '' END || fragment
        ELSE scheme || '://' || host || path || '?[redacted-query]' || CASE WHEN fragment = '#' THEN '' ELSE fragment END END AS redacted FROM told_"""
)
def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages, some with dots, odd characters, ports, logins and international hosts, in their normal form and with their query hidden."""
    return T.odd_urls(spark, sf_dir).select("page_id", U.redact_url(F.col("url")).alias("redacted"))


@query(
    f"""WITH {_urls('pages')}, r_ AS (SELECT page_id, {_REDACTED} AS r FROM urls_)
    SELECT page_id, 'GET ' || r || ' failed, again at ' || r || ' later' AS message FROM r_"""
)
def redact_error_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("GET "), F.col("url"), F.lit(" failed, again at "), F.col("url"), F.lit(" later"))
    return T.table(spark, sf_dir, "pages").select("page_id", U.redact_urls_in(message).alias("message"))


@query(
    """WITH n AS (SELECT 'c' || (page_id // 8) AS conversation_id, page_id % 8 // 4 AS m, count(*) AS n FROM pages GROUP BY ALL)
    SELECT conversation_id, CAST(m AS INTEGER) AS message_index, n AS n_files, CASE WHEN n > 3 THEN 'A requisição contém ' || n || ' arquivos, acima do limite configurado de 3.' END AS error FROM n"""
)
def file_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.message_files(spark, sf_dir).groupBy("conversation_id", "message_index").agg(F.count("*").alias("n_files"))
    return n.withColumn("error", M.file_count_error(F.col("n_files"), 3))


@query("SELECT 'f' || page_id AS file_id, length(html) AS n_bytes, CASE WHEN length(html) > 5000 THEN 'FILE_LIMIT_EXCEEDED' END AS code FROM pages")
def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.message_files(spark, sf_dir).select("file_id", F.length("html").cast("long").alias("n_bytes"))
    return f.withColumn("code", M.size_error(F.col("n_bytes"), 5000))


@query(
    """WITH d AS (SELECT page_id, [200, 404, 403, 500, 302][1 + page_id % 5] AS status, CASE WHEN page_id % 11 = 0 THEN 'timeout of 30000ms exceeded' END AS failure FROM pages)
    SELECT 'f' || page_id AS file_id, CASE WHEN failure IS NOT NULL THEN 'Failed to fetch file: ' || failure WHEN status >= 500 THEN 'Failed to fetch file: Request failed with status code ' || status
    WHEN status = 404 THEN 'Arquivo não encontrado no bucket. Verifique se o arquivo existe.' WHEN status >= 400 THEN 'Erro HTTP ' || status || ': Forbidden' END AS error FROM d"""
)
def download_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.message_files(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, (200, 404, 403, 500, 302))), (F.col("page_id") % 5 + 1).cast("int"))
    return f.select("file_id", M.download_error(status, F.lit("Forbidden"), F.when(F.col("page_id") % 11 == 0, "timeout of 30000ms exceeded")).alias("error"))


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.message_files(spark, sf_dir).withColumn("r", M.route(F.col("mime_type")))
    value = F.when(F.col("r.error").isNull(), X.sanitize(F.col("html")))
    return files.select("conversation_id", "message_index", "file_index", "file_id", "url", value.alias("value"), F.col("r.error").alias("error"), F.lit(None).cast("string").alias("code"))


_ERROR_TAIL = "'[FILE_PROCESSING_ERROR]' || chr(10) || 'Este arquivo não foi processado integralmente.' || chr(10) || 'Motivo: Unsupported file type: ' || key || chr(10) || 'Oriente o usuário a reduzir, dividir ou reenviar uma versão compatível do arquivo, se necessário.'"
_BLOCKS = f"""{_FILES}, {_ROUTED}, {_urls('typed_')}, blocks_ AS (SELECT *, '## Transcricao do arquivo: ' || regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$') || ':' || chr(10) || chr(10)
    || CASE WHEN extractor IS NULL THEN {_ERROR_TAIL} ELSE {_sanitize('html')} END AS block FROM urls_)"""
_JOINED = "string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY message_index, file_index)"


@query(
    f"WITH {_BLOCKS}, listed_ AS (SELECT conversation_id, {_JOINED} AS joined FROM blocks_ GROUP BY conversation_id) "
    f"SELECT conversation_id, {_sanitize_text(_trim('joined'))} AS text, conversation_id || '-{T.NOW_MS}.txt' AS filename, 'https://files.example.com/texts/' || conversation_id || '/' || conversation_id || '-{T.NOW_MS}.txt' AS download_url FROM listed_"
)
def assembled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.assembled(_processed(spark, sf_dir), T.NOW_MS, "files.example.com").select("conversation_id", "text", "filename", "download_url")


@query(
    f"""WITH {_FILES}, {_ROUTED} SELECT conversation_id, coalesce(string_agg(file_id, ',' ORDER BY message_index, file_index) FILTER (extractor IS NOT NULL), '') AS processed,
    coalesce(string_agg(file_id || '=' || 'Unsupported file type: ' || key, ',' ORDER BY message_index, file_index) FILTER (extractor IS NULL), '') AS failed FROM typed_ GROUP BY conversation_id"""
)
def processed_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = M.assembled(_processed(spark, sf_dir), T.NOW_MS, "files.example.com")
    failed = F.array_join(F.transform("failed_files", lambda x: F.concat_ws("=", x["fileId"], x["error"])), ",")
    return told.select("conversation_id", F.array_join("processed_files", ",").alias("processed"), failed.alias("failed"))


_MESSAGES = """WITH messages_ AS (SELECT conv_id AS request_id, CAST(turn AS INTEGER) AS message_index, CASE WHEN turn <> 6 THEN CAST(conv_id AS VARCHAR) END AS conversation_id, text, conv_id % 10 <> 3 AS has_body, turn % 4 AS n,
    conv_id % 9 <> 1 AS has_id, turn % 5 <> 2 AS has_url, CASE WHEN turn % 2 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime, conv_id % 4 <> 0 AS has_second FROM conversations)"""


@query(
    _MESSAGES
    + """, one_ AS (SELECT *, CASE WHEN has_body THEN n ELSE 0 END AS k FROM messages_)
    SELECT request_id, message_index, conversation_id, CAST(length(text) AS BIGINT) AS content_length, k AS files_count,
    array_to_string(list_sort(list_distinct(list_filter([CASE WHEN k >= 1 THEN mime END, CASE WHEN k >= 2 AND has_second THEN 'image/png' END, CASE WHEN k >= 3 THEN mime END], lambda x: x IS NOT NULL))), ',') AS file_types
    FROM one_ WHERE message_index < 5"""
)
def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.request_summary(T.messages(spark, sf_dir))


@query(
    _MESSAGES
    + """, issues_ AS (SELECT request_id, message_index, list_filter(
        [CASE WHEN conversation_id IS NULL THEN 'conversationId: required' END, CASE WHEN NOT has_body THEN 'body: required' END]
        || flatten(list_transform(range(0, CASE WHEN has_body THEN n ELSE 0 END), lambda i: [CASE WHEN NOT has_id THEN 'files.' || i || '.fileId: required' END,
           CASE WHEN NOT has_url THEN 'files.' || i || '.url: invalid' END, CASE WHEN i = 1 AND NOT has_second THEN 'files.' || i || '.mimeType: required' END])), lambda x: x IS NOT NULL) AS issues FROM messages_)
    SELECT request_id, message_index, array_to_string(issues, '; ') AS issues FROM issues_ WHERE len(issues) > 0"""
)
def validation_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.validated(T.messages(spark, sf_dir)).where(F.size("issues") > 0).select("request_id", "message_index", F.array_join("issues", "; ").alias("issues"))


@query("SELECT 'c' || (page_id // 8) AS conversation_id, string_agg('f' || page_id || '.txt', ',' ORDER BY page_id) AS deleted_files, count(*) AS deleted_count FROM pages GROUP BY 1")
def delete_texts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deleting the outputs of all conversations takes away."""
    f = T.message_files(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.struct("page_id", F.concat("file_id", F.lit(".txt")).alias("n"))))
    return f.groupBy("conversation_id").agg(F.array_join(F.transform(listed, lambda x: x["n"]), ",").alias("deleted_files"), F.count("*").alias("deleted_count"))


@query(
    f"WITH {_FILES} SELECT file_id, mime_type IN ({', '.join(_lit(a) for a in M.AUDIO_TYPES)}) AND length(html) <= {M.MAX_AUDIO_BYTES} AS accepted, CASE WHEN url LIKE '%/en/%' THEN 'none' ELSE 'main' END AS token FROM files_"
)
def transcription_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("url").contains("/en/"), "/texts/a").otherwise("/api/transcribe")
    return T.message_files(spark, sf_dir).select("file_id", M.accepted_audio(F.col("mime_type"), F.length("html")).alias("accepted"), M.needs_token(path).alias("token"))


@query("SELECT page_id, 'data:image/png;base64,' || to_base64(encode(html)) AS data_url FROM pages")
def image_data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", M.data_url(F.lit("image/png"), F.encode("html", "UTF-8")).alias("data_url"))


@query(
    f"""WITH {_FILES}, {_ROUTED} SELECT file_id, 'O processamento deste arquivo ' || upper(extractor) || ' excedeu o tempo limite de ' || CASE extractor
    {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.TIMEOUT_SECONDS.items())} END || ' segundos.' AS error FROM typed_ WHERE extractor IS NOT NULL"""
)
def timeout_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.message_files(spark, sf_dir).select("file_id", M.route(F.col("mime_type"))["extractor"].alias("extractor")).where("extractor IS NOT NULL")
    return files.select("file_id", M.timeout_error(F.col("extractor")).alias("error"))


@query("SELECT 'page-' || page_id || '.png' AS name, row_number() OVER (PARTITION BY page_id // 1000 ORDER BY page_id) AS k FROM pages")
def natural_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files of folders of a thousand in the order of their numbers."""
    files = T.table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 1000).alias("folder"), F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".png")).alias("name"))
    return files.select("name", F.row_number().over(Window.partitionBy("folder").orderBy(X.natural_order(F.col("name")))).cast("long").alias("k"))


# --- jobs ------------------------------------------------------------------------------------------------------------

_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STATUS_OF.items())
_JOBS = f"""WITH e AS (SELECT event_id, user_id, CASE event_type {_STATUS} ELSE 'queued' END AS status, epoch_us(ts) // 1000 AS created_ms FROM events),
    jobs_ AS (SELECT event_id AS id, user_id, status, CASE WHEN status = 'failed' THEN 'falhou' WHEN status = 'expired' THEN 'O processamento excedeu o tempo limite' END AS error,
    CASE WHEN status = 'completed' THEN 'r' || event_id END AS result, created_ms, created_ms + event_id % 50 * 60000 AS updated_ms,
    CASE WHEN status <> 'queued' AND event_id % 4 <> 0 THEN created_ms + 60000 END AS started_ms,
    CASE WHEN status IN ('completed', 'failed', 'expired') AND event_id % 3 <> 0 THEN created_ms + event_id % 1000 * 1000 END AS finished_ms FROM e)"""
_TEN_DAYS, _TWENTY_DAYS = 10 * 86_400_000, 20 * 86_400_000
_STALE = f"status IN ('queued', 'processing') AND coalesce(started_ms, updated_ms, created_ms) < {T.NOW_MS - _TEN_DAYS}"


@query(
    _JOBS
    + f""" SELECT id, CASE WHEN {_STALE} THEN 'expired' ELSE status END AS status, CASE WHEN {_STALE} THEN 'Job expirado apos {_TEN_DAYS}ms sem conclusao' ELSE error END AS error,
    CASE WHEN {_STALE} THEN {T.NOW_MS} ELSE finished_ms END AS finished_ms, {_STALE} AS expired_now FROM jobs_"""
)
def job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.expire_stale(T.job_records(spark, sf_dir), T.NOW_MS, _TEN_DAYS).select("id", "status", "error", "finished_ms", "expired_now")


_PAST = f"status IN ('completed', 'failed', 'expired') AND coalesce(finished_ms, updated_ms) < {T.NOW_MS - _TWENTY_DAYS}"


@query(_JOBS + f" SELECT id, status FROM jobs_ WHERE NOT ({_PAST})")
def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.retained(T.job_records(spark, sf_dir), T.NOW_MS, _TWENTY_DAYS).select("id", "status")


@query(
    _JOBS
    + f""", tick_ AS (SELECT user_id, CASE WHEN {_STALE} THEN 'expired' ELSE status END AS status, {_STALE} AS expired_now, CASE WHEN {_STALE} THEN {T.NOW_MS} ELSE finished_ms END AS finished_ms,
    CASE WHEN {_STALE} THEN {T.NOW_MS} ELSE updated_ms END AS updated_ms FROM jobs_)
    SELECT user_id, count(*) AS jobs, count(*) FILTER (expired_now) AS expired, count(*) FILTER ({_PAST}) AS deleted FROM tick_ GROUP BY user_id"""
)
def maintenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a maintenance tick does for each user's jobs: stale ones expire, then those past retention go."""
    ticked = J.expire_stale(T.job_records(spark, sf_dir), T.NOW_MS, _TEN_DAYS).withColumn("gone", J.is_past_retention(T.NOW_MS, _TWENTY_DAYS))
    return ticked.groupBy("user_id").agg(F.count("*").alias("jobs"), F.count_if("expired_now").alias("expired"), F.count_if("gone").alias("deleted"))


@query(
    _JOBS
    + f""", queue_ AS (SELECT id + id % 2 * 1000000 AS job_id, created_ms AS position FROM jobs_)
    SELECT q.job_id, q.position, CASE WHEN j.status = 'queued' AND {T.NOW_MS} - j.created_ms > {_TEN_DAYS} THEN 'expired' WHEN j.status = 'queued' THEN 'kept' ELSE 'dropped' END AS outcome
    FROM queue_ q LEFT JOIN jobs_ j ON j.id = q.job_id"""
)
def queue_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = T.job_records(spark, sf_dir)
    queue = jobs.select((F.col("id") + F.col("id") % 2 * 1000000).alias("job_id"), F.col("created_ms").alias("position"))
    return J.pruned_queue(queue, jobs, T.NOW_MS, _TEN_DAYS)


@query(_JOBS + " SELECT id, user_id, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms, id) AS k FROM jobs_ WHERE status = 'queued') WHERE k <= 2")
def job_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two oldest queued jobs of each user."""
    return J.dispatched(T.job_records(spark, sf_dir), 2, "user_id").select("id", "user_id", "created_ms")


@query(_JOBS + " SELECT id, created_ms FROM jobs_ WHERE status = 'queued' ORDER BY created_ms, id LIMIT 5")
def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five oldest queued jobs of all: a top-k."""
    return J.dispatched(T.job_records(spark, sf_dir), 5).select("id", "created_ms")


@query(_JOBS + " SELECT id, id IN (SELECT id FROM jobs_ ORDER BY created_ms, id LIMIT 100) AS accepted FROM jobs_")
def queue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that an empty queue has room for."""
    return J.admitted(T.job_records(spark, sf_dir), 0, Limits.jobs_max_queue).select("id", "accepted")


@query(
    _JOBS
    + f""", new_ AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'excedeu o tempo limite de 1' ELSE 'x' END AS e FROM jobs_ WHERE id % 2 = 0)
    SELECT j.id, CASE WHEN n.id IS NULL OR j.status IN ('completed', 'failed', 'expired') THEN j.status WHEN n.e IS NULL THEN 'completed' WHEN contains(n.e, 'excedeu o tempo limite') THEN 'expired' ELSE 'failed' END AS status,
    CASE WHEN n.id IS NULL OR j.status IN ('completed', 'failed', 'expired') THEN j.error ELSE coalesce(n.e, j.error) END AS error,
    CASE WHEN n.id IS NULL OR j.status IN ('completed', 'failed', 'expired') THEN j.updated_ms ELSE {T.NOW_MS} END AS updated_ms FROM jobs_ j LEFT JOIN new_ n ON n.id = j.id"""
)
def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of every second job merged into the records; finished jobs stay as they are."""
    jobs = T.job_records(spark, sf_dir)
    error = F.when(F.col("id") % 3 == 1, "excedeu o tempo limite de 1").when(F.col("id") % 3 == 2, "x")
    updates = jobs.where("id % 2 = 0").select("id", J.completion(error).alias("status"), error.alias("error"))
    return J.updated(jobs, updates, T.NOW_MS).select("id", "status", "error", "updated_ms")


@query(_JOBS + " SELECT user_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in J.STATUSES) + " FROM jobs_ GROUP BY user_id")
def job_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.status_counts(T.job_records(spark, sf_dir), "user_id")


@query(
    _JOBS
    + """ SELECT id, status, CASE WHEN status IN ('queued', 'processing') THEN 202 ELSE 200 END AS http_status, CASE WHEN status IN ('failed', 'expired') THEN error END AS error,
    CASE WHEN status = 'completed' THEN result END AS result FROM jobs_"""
)
def job_result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.result_view(T.job_records(spark, sf_dir))


_ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@query(
    _JOBS
    + f""" SELECT id, '{{"id":' || id || ',"status":"' || status || '"' || coalesce(',"result":"' || result || '"', '') || coalesce(',"error":"' || error || '"', '')
    || ',"createdAt":"' || {_ISO.format("created_ms")} || '","updatedAt":"' || {_ISO.format("updated_ms")} || '"' || coalesce(',"startedAt":"' || {_ISO.format("started_ms")} || '"', '')
    || coalesce(',"finishedAt":"' || {_ISO.format("finished_ms")} || '"', '') || '}}' AS json FROM jobs_"""
)
def job_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.record_json(T.job_records(spark, sf_dir))


# --- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS hour_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind in each hour, counted by a stream over the table's files that ends when it has read all."""
    schema = T.table(spark, sf_dir, "events").schema
    source = table_stream(spark, sf_dir, "events.parquet", schema)
    counts = hourly_counts(source.withColumn("ts", F.col("ts").cast("timestamp")))
    hour = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(hour_start as timestamp_ntz))")
    return run_once(counts, scratch_path(spark, "streams")).select(hour.alias("hour_ms"), "event_type", "n")
