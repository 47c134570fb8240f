"""The model's tables built from the given ones: conversations as the pages of a PDF file, benchmark items as OCR text, and so on."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that a task makes at once.
TOGETHER = 500
NOW_MS = 1706745600000  # 2024-02-01T00:00:00Z
#: What a core reads at a time, as Spark has it by default.
PART_BYTES = 128 << 20
#: Status and content of a job record by the kind of event that it is made from.
STATUS_OF = {"signup": "queued", "view": "processing", "click": "completed", "error": "failed", "purchase": "expired"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is a small table in fewer files than those: less than PART_BYTES for each by Spark's own estimate. A
    larger one, or one of many files, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * PART_BYTES and len(df.inputFiles()) < cores else df


def native_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page_number, text: a turn of a conversation is a page."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page_number"), "text")


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, total_pages, n_bytes: every third file has a last page without text."""
    pages = native_pages(spark, sf_dir).groupBy("file_id").agg(F.max("page_number").alias("last"))
    total = F.col("last") + F.when(F.col("file_id") % 3 == 0, 1).otherwise(0)
    return pages.select("file_id", total.alias("total_pages"), (total * (20000 + F.col("file_id") * 997 % 60000)).alias("n_bytes"))


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = native_pages(spark, sf_dir).where((F.col("file_id") * 7 + F.col("page_number") * 3) % 5 == 0)
    return pages.select("file_id", "page_number", (F.col("file_id") % 3 + 1).alias("embedded_image_count"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = native_pages(spark, sf_dir).where((F.col("file_id") + F.col("page_number")) % 11 == 0)
    return pages.select("file_id", "page_number", F.lit(1).cast("long").alias("table_count"))


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page_number, ocr_text of every page: an item of benchmark, all of them in turn, blank for some."""
    benchmark = table(spark, sf_dir, "benchmark")
    n_items = benchmark.agg(F.max("item_id") + 1).first()[0]  # one number
    pages = native_pages(spark, sf_dir).select("file_id", "page_number", ((F.col("file_id") * 8 + F.col("page_number") - 1) % F.lit(n_items).cast("long")).alias("item_id"))
    items = benchmark.select("item_id", F.col("text").alias("item"))
    blank = (F.col("file_id") + F.col("page_number")) % 6 == 0
    return pages.join(items, "item_id", "left").select("file_id", "page_number", F.when(blank, " \n ").otherwise(F.coalesce("item", F.lit(""))).alias("ocr_text"))


def native_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, text, total_pages, n_bytes: a document of documents is a PDF file's native text."""
    docs = spread(table(spark, sf_dir, "documents"))
    total = F.greatest(F.ceil(F.col("n_chars") / 1800), F.lit(1)).cast("long")
    return docs.select(F.col("doc_id").alias("file_id"), "text", total.alias("total_pages"), (total * (F.col("doc_id") * 7919 % 90000)).alias("n_bytes"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, attempt, confidence, words, chars: the lines of an order are attempts at a page."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("attempt"), "l_quantity", "l_partkey", "l_suppkey")
    # dealt by page, what follows is grouped by page without another shuffle
    return lines.repartition("page").groupBy("page", "attempt").agg(
        (F.max("l_quantity") * 2).alias("confidence"), (F.max("l_partkey") % 200).alias("words"), (F.max("l_suppkey") * 37 % 900).alias("chars")
    )


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).where("attempt IN (3, 4)").select("page", F.when(F.col("attempt") == 3, 90).otherwise(270).alias("angle"), "confidence", "words", "chars")


def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, k, line: TSV rows of recognised words, made from the lines of an order."""
    it = table(spark, sf_dir, "lineitem")
    cells = (
        F.when(F.col("l_quantity") > 45, "4").otherwise("5"),
        F.lit("1"),
        (F.col("l_partkey") % 2).cast("string"),
        F.lit("1"),
        (F.col("l_suppkey") % 3).cast("string"),
        *[F.lit("0")] * 5,
        F.when(F.col("l_returnflag") == "R", "-1").otherwise(F.col("l_quantity").cast("int").cast("string")),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("w"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("l_returnflag"))),
    )
    line = F.concat_ws("\t", *cells)
    short = F.when(F.col("l_partkey") % 13 == 0, F.substring_index(line, "\t", 6)).otherwise(line)
    return it.select(F.col("l_orderkey").alias("page_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", short.alias("line")).alias("k"), short.alias("line"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, sheet_index, sheet, row_index, cells: a thousand customers are a file, those of a segment rows of a sheet, some of them blank."""
    blank = F.col("c_custkey") % 7 == 0
    cells = F.when(blank, F.array(F.lit(""), F.lit(" \t"), F.lit(None).cast("string"))).otherwise(F.array("c_name", F.col("c_custkey").cast("string"), F.lit("")))
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    index = F.coalesce(*[F.when(F.col("c_mktsegment") == s, i) for i, s in enumerate(segments)], F.lit(len(segments)))
    return table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 1000).alias("file_id"), index.alias("sheet_index"), F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("row_index"), cells.alias("cells")
    )


def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job records, one for each event; times in milliseconds."""
    ts = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS_OF.items()], F.lit("queued"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"), ts.alias("created_ms"))
    started = F.when((F.col("status") != "queued") & (F.col("event_id") % 4 != 0), F.col("created_ms") + 60000)
    finished = F.when(F.col("status").isin("completed", "failed", "expired") & (F.col("event_id") % 3 != 0), F.col("created_ms") + F.col("event_id") % 1000 * 1000)
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        "status",
        F.when(F.col("status") == "failed", "falhou").when(F.col("status") == "expired", "O processamento excedeu o tempo limite").alias("error"),
        F.when(F.col("status") == "completed", F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("result"),
        "created_ms",
        (F.col("created_ms") + F.col("event_id") % 50 * 60000).alias("updated_ms"),
        started.alias("started_ms"),
        finished.alias("finished_ms"),
    )


MIMES = (
    "application/pdf", "text/plain", "image/png", "audio/ogg", "application/msword", "application/zip", "image/jpeg", "foo/pdf",
    "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain; charset=utf-8", "binary",
)


def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation_id, message_index, file_index, file_id, url, mime_type, html: a page of pages is a file; eight files a conversation."""
    p = table(spark, sf_dir, "pages")
    mime = F.element_at(F.array(*[F.lit(m) for m in MIMES]), (F.col("page_id") % len(MIMES) + 1).cast("int"))
    return p.select(
        F.concat(F.lit("c"), F.floor(F.col("page_id") / 8).cast("string")).alias("conversation_id"),
        F.floor(F.col("page_id") % 8 / 4).cast("int").alias("message_index"),
        (F.col("page_id") % 4).cast("int").alias("file_index"),
        F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file_id"),
        "url",
        mime.alias("mime_type"),
        "html",
        "page_id",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, message_index, conversationId, content, body: a turn is a message with turn % 4 files; some are faulty."""
    c = table(spark, sf_dir, "conversations")
    one = F.struct(
        F.when(F.col("conv_id") % 9 != 1, F.concat(F.lit("f"), F.col("conv_id").cast("string"))).alias("fileId"),
        F.when(F.col("turn") % 5 == 2, "no url").otherwise(F.concat(F.lit("https://h.example.com/a/"), F.col("conv_id").cast("string"))).alias("url"),
        F.when(F.col("turn") % 2 == 0, "application/pdf").otherwise("text/plain").alias("mimeType"),
    )
    two = one.withField("mimeType", F.when(F.col("conv_id") % 4 == 0, F.lit(None).cast("string")).otherwise("image/png"))
    files = F.slice(F.array(one, two, one), F.lit(1), (F.col("turn") % 4).cast("int"))
    body = F.when(F.col("conv_id") % 10 != 3, F.struct(files.alias("files")))
    return c.select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").cast("int").alias("message_index"),
        F.when(F.col("turn") != 6, F.col("conv_id").cast("string")).alias("conversationId"),
        F.col("text").alias("content"),
        body.alias("body"),
    )


#: What becomes of the address of every eighth page, by the number modulo eight: in SQL and in Spark, whose regexp_replace reads the same.
ODD_URLS_SQL = {
    1: "regexp_replace(url, '^(https?://)', '\\1b' || chr(252) || 'cher-' || page_id || '.')",
    2: "regexp_replace(url, '([?#]|$)', '/./' || chr(231) || page_id || '/../%2E%2e/d e/..\\1')",
    3: "upper(url)",
    4: "regexp_replace(url, '^(https?://)', '\\1us er:p' || chr(233) || 'w@')",
    5: "regexp_replace(url, '^(https?)://([^/?#]+)', '\\1://' || chr(20363) || chr(12360) || '.\\2:0443')",
    6: "url || '#' || chr(128512) || '<>'",
    7: "'no ' || url",
}


def odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url: addresses of pages, seven of eight made odd."""
    page = F.col("page_id").cast("string")
    u, sub = F.col("url"), F.regexp_replace
    odd = {
        1: sub(u, F.lit("^(https?://)"), F.concat(F.lit("$1bücher-"), page, F.lit("."))),
        2: F.concat(sub(u, "[?#].*$", ""), F.lit("/./ç"), page, F.lit("/../%2E%2e/d e/.."), F.regexp_extract(u, "[?#].*$", 0)),
        3: F.upper(u),
        4: sub(u, "^(https?://)", "$1us er:péw@"),
        5: sub(u, "^(https?)://([^/?#]+)", "$1://例え.$2:0443"),
        6: F.concat(u, F.lit("#\U0001f600<>")),
        7: F.concat(F.lit("no "), u),
    }
    kind = F.col("page_id") % 8
    url = F.coalesce(*[F.when(kind == k, v) for k, v in odd.items()], u)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, extractor, content: the lines of a turn as the bytes of a text file or of a word-processing document, and rows of customers as workbooks."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("t"), "conv_id", "turn").alias("file_id"), F.when(F.col("turn") % 2 == 0, "txt").otherwise("docx").alias("extractor"), F.split("text", "\n").alias("rows"))
    cells = F.concat_ws("\t", "c_name", F.col("c_custkey").cast("string"), "c_mktsegment")
    books = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("book")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", cells.alias("cells")))), lambda x: x["cells"]).alias("rows"))
    every = turns.unionByName(books.select(F.concat(F.lit("b-"), F.col("book").cast("string")).alias("file_id"), F.lit("xlsx").alias("extractor"), "rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                file_id, extractor, rows = batch.slice(k, TOGETHER).columns
                content = [FILE_BYTES[kind](own) for kind, own in zip(extractor.to_pylist(), rows.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([file_id, extractor, pa.array(content, pa.binary())], names=["file_id", "extractor", "content"])

    return spread(every).mapInArrow(run, "file_id string, extractor string, content binary")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(rows: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in rows)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def _xlsx(rows: list[str]) -> bytes:
    cells = lambda k, x: "".join(f'<c r="{"ABC"[i]}{k}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for i, v in enumerate(x.split("\t")))
    sheet = "".join(f"<row>{cells(k, x)}</row>" for k, x in enumerate(rows, 1))
    return _zipped(
        {
            "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Clientes" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{sheet}</sheetData></worksheet>",
        }
    )


FILE_BYTES = {"txt": lambda rows: "\n".join(rows).encode(), "docx": _docx, "xlsx": _xlsx}
