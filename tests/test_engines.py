import io
import json
import zipfile

from pyspark.sql import functions as F

from pagemill.functions.text import natural_order
from pagemill.operators.jobs import RECORD_SCHEMA, error_json, record_json
from pagemill.operators.pages import page_spine, probed_pages, selected_chunks, with_visuals
from pagemill.operators.sheets import sheet_texts, workbook_texts
from pagemill.sources import engines, extract, readers


def workbook(formats):
    out = io.BytesIO()
    styles = "".join(f'<xf numFmtId="{k}"/>' for k in formats)
    cells = "".join(f'<c r="{"ABCDEFGHIJ"[k]}1" s="{k}"><v>{v}</v></c>' for k, v in enumerate(formats.values()))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs>{styles}</cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet><sheetData><row>{cells}</row><row><c r="A2" t="b"><v>1</v></c></row><row><c r="B3"><v> </v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet><sheetData/></worksheet>")
    return out.getvalue()


BOOK = workbook({0: "0.30000000000000004", 9: "0.256", 10: "0.256", 4: "1234567.891", 14: "45292", 164: "45292.5", 1: "2.5", 49: "7"})


def test_cells_are_as_they_are_shown():
    rows = [r[3] for r in extract.xlsx_rows(BOOK)]
    assert rows[0] == ["0.3", "26%", "25.60%", "1,234,567.89", "1/1/24", "2024-01-01 12:00", "2", "7"]
    shown = extract.formatted
    assert [shown("44927.75", c) for c in ("m/d/yyyy h:mm AM/PM", "mmm-yy", "h:mm:ss", '"R$" #,##0.00', "[Red]0.0;-0.0")] == ["1/1/2023 6:00 PM", "Jan-23", "18:00:00", "44,927.75", "44927.8"]
    assert [shown(x, None) for x in ("12345678901234", "1e-7", "99999999999", "-2", "0", "1234.5", "x")] == ["1.23457E+13", "1E-07", "99999999999", "-2", "0", "1234.5", "x"]


def test_workbooks_among_other_files(spark):
    files = spark.createDataFrame([("x", "xlsx", bytearray(BOOK)), ("bad", "xlsx", bytearray(b"?"))], "file_id string, extractor string, content binary")
    got = {r.file_id: r for r in extract.extract_texts(files, extract.registry(), clean=False).collect()}
    assert got["bad"].value is None and got["bad"].error
    text = workbook_texts(sheet_texts(extract.extract_sheets(files.where("file_id = 'x'")))).first().text
    assert got["x"].value.startswith("=== ARQUIVO EXCEL ===\nResumo: Planilha Excel com 2 aba(s): A, B\nTotal de abas: 2\nTotal de células: 16\n\n=== ABA 1: A ===\n0.3\t26%")
    assert got["x"].value.split("=== ABA 1")[1].split("\n\n")[0] == text.split("=== ABA 1")[1].split("\n\n")[0]


def test_pages_of_an_engine_feed_the_spine(spark):
    def engine(content):
        if content == b"broken":
            raise ValueError("no pages")
        return [(t, int("i" in t), int("t" in t)) for t in content.decode().split("|") if t]

    files = spark.createDataFrame([("a", bytearray(b"one|it|x")), ("b", bytearray(b"broken")), ("c", bytearray(b""))], "file_id string, content binary")
    told = engines.extract_pages(files, engine)
    rows = sorted(((r.file_id, r.page_number, r.text, r.total_pages, r.error) for r in told.collect()), key=repr)
    assert rows == sorted([("a", 1, "one", 3, None), ("a", 2, "it", 3, None), ("a", 3, "x", 3, None), ("b", None, None, None, "no pages"), ("c", None, None, 0, None)], key=repr)
    pages = told.where("page_number IS NOT NULL")
    spine = page_spine(pages.groupBy("file_id").agg(F.max("total_pages").alias("total_pages")), pages.select("file_id", "page_number", "text"))
    seen = with_visuals(spine, pages.select("file_id", "page_number", "embedded_image_count"), pages.select("file_id", "page_number", "table_count"))
    assert {(r.page_number, r.has_visual_content) for r in seen.collect()} == {(1, False), (2, True), (3, False)}
    probes = engines.probe_files(files, lambda c: (True, len(list(engine(c))) - 1))
    assert {(r.file_id, r.valid, r.page_count) for r in probes.collect()} == {("a", True, 2), ("b", False, 0), ("c", True, -1)}
    chosen = probed_pages(pages.select("file_id", "page_number"), probes)
    chunks = selected_chunks(chosen)
    assert [tuple(r) for r in chunks.collect()] == [("a", 1, 2)]
    word = lambda w: "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t90\t" + w


def test_staged_content(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.txt").write_bytes(b"x" * 10)
    (tmp_path / "s" / "two.txt").write_bytes(b"x" * 20)
    staged = readers.read_staged_files(spark, str(tmp_path / "s"), max_bytes=15)
    files = spark.createDataFrame([(f"file:{tmp_path}/s/{n}.txt",) for n in ("one", "two", "none")], "url string")
    got = {r.url.rpartition("/")[2]: (r.content is not None, r.code, r.error) for r in readers.with_staged_content(files, staged).collect()}
    assert got == {"one.txt": (True, None, None), "two.txt": (False, "FILE_LIMIT_EXCEEDED", "Arquivo acima do limite configurado"), "none.txt": (False, None, "Arquivo não encontrado no bucket. Verifique se o arquivo existe.")}


def test_names_in_natural_order(spark):
    names = ["p-2-10.png", "p-2-9.png", "p-10-1.png", "P-1-1.png", "p.png", "p-02-9.png", "10", "9", "a" + "9" * 50, "a" + "1" + "0" * 50, None]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_order(F.col("n"))).collect()]
    assert got == [None, "9", "10", "a" + "9" * 50, "a1" + "0" * 50, "P-1-1.png", "p-02-9.png", "p-2-9.png", "p-2-10.png", "p-10-1.png", "p.png"]


def test_records_and_errors_as_json(spark):
    job = spark.createDataFrame([("j", "process-message", "failed", '{"a":1}', "h", "https", None, "no", 0, 1500, None, None)], RECORD_SCHEMA)
    assert json.loads(record_json(job).first().json) == {"id": "j", "type": "process-message", "status": "failed", "request": '{"a":1}', "host": "h", "protocol": "https", "error": "no", "createdAt": "1970-01-01T00:00:00.000Z", "updatedAt": "1970-01-01T00:00:01.500Z"}
    e = spark.createDataFrame([("TypeError", "bad", "at x"), (None, "plain", None), (None, None, None)], "name string, message string, stack string")
    assert [json.loads(r.j) for r in e.select(error_json(F.col("name"), F.col("message"), F.col("stack")).alias("j")).collect()] == [{"name": "TypeError", "message": "bad", "stack": "at x"}, {"value": "plain"}, {"value": "null"}]


def test_streamed_folders(spark, tmp_path):
    from pagemill.streaming.jobs import table_stream

    spark.range(10).repartition(3).write.parquet(str(tmp_path / "e" / "events.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "f"))
    one = next((tmp_path / "f").glob("part-*"))
    one.rename(tmp_path / "f" / "events.parquet")
    for folder, n in (("e", 10), ("f", 4)):
        stream = table_stream(spark, f"file://{tmp_path}/{folder}", "events.parquet", spark.range(1).schema)
        stream.writeStream.format("memory").queryName(f"rows_{folder}").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"rows_{folder}").count() == n


def test_requests_with_wrong_types(spark, tmp_path):
    good = {"conversationId": "c", "body": {"files": [{"fileId": "f", "url": "https://a.b/c", "mimeType": "text/plain", "extra": 1}]}}
    wrong = {"conversationId": 5, "body": {"files": [{"fileId": 7, "url": "https://a.b/c", "mimeType": "text/plain"}, {"fileId": "g", "url": True, "mimeType": None}]}}
    (tmp_path / "a.json").write_text(json.dumps([good, wrong, {"conversationId": None}, {"body": 5}]))
    (tmp_path / "b.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "c.json").write_text("{nothing")
    ok, bad = readers.split_valid(readers.read_requests(spark, str(tmp_path)))
    assert [(r.conversationId, r.body.files[0].fileId, r.body.files[0].mimeType) for r in ok.collect()] == [("c", "f", "text/plain")] * 2
    assert sorted(r.issues for r in bad.select("issues").collect()) == sorted(
        [
            ["files.1.url: invalid", "files.1.mimeType: required", "conversationId: not a string", "files.0.fileId: not a string", "files.1.url: not a string"],
            ["conversationId: required", "body: required"],
            ["conversationId: required", "body: required"],
            ["body: invalid JSON", "conversationId: required", "body: required"],
        ]
    )
