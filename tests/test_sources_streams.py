import io
import json
import zipfile

from pagemill.sources import extract, readers, sinks


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Um</w:t><w:tab/><w:t>dois</w:t></w:r></w:p><w:p><w:r><w:t>três</w:t></w:r></w:p></w:body></w:document>"})
XLSX = zipped(
    {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Plan" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>nome</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    }
)


def test_extractors(spark):
    rows = [("t", "txt", b"a \xff\n b"), ("d", "docx", DOCX), ("p", "pdf", b"%PDF"), ("bad", "docx", b"no zip")]
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "file_id string, extractor string, content binary")
    got = {r.file_id: (r.value, r.error) for r in extract.extract_texts(df, extract.registry()).collect()}
    assert got["t"] == ("a � b", None) and got["d"] == ("Um dois três", None)
    assert got["p"] == (None, "no pdf engine is configured") and got["bad"][0] is None and got["bad"][1]
    given = extract.registry(pdf=lambda content: content.decode())
    assert {r.file_id: r.value for r in extract.extract_texts(df, given).collect()}["p"] == "%PDF"


def test_sheets(spark):
    df = spark.createDataFrame([("x", bytearray(XLSX)), ("bad", bytearray(b"?"))], "file_id string, content binary")
    got = sorted(((r.file_id, r.row_index, r.cells, r.error is None) for r in extract.extract_sheets(df).collect()), key=repr)
    assert got == [("bad", None, None, False), ("x", 0, ["nome", "", "5"], True), ("x", 1, ["", "x", ""], True)]


def test_requests_and_files(spark, tmp_path):
    good = {"conversationId": "c", "body": {"files": [{"fileId": "f", "url": "https://a.b/c", "mimeType": "text/plain", "extra": 1}]}}
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text(json.dumps([good, {"body": {"files": [{"url": "x"}]}}]))
    (tmp_path / "q" / "b.json").write_text(json.dumps(good))
    (tmp_path / "q" / "c.json").write_text("{nothing")
    ok, bad = readers.split_valid(readers.read_requests(spark, str(tmp_path / "q")))
    assert ok.count() == 2 and bad.count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.txt").write_bytes(b"x" * 10)
    (tmp_path / "s" / "two.txt").write_bytes(b"x" * 20)
    staged = readers.read_staged_files(spark, str(tmp_path / "s"), max_bytes=15)
    assert {(r.length, r.content is None, r.code) for r in staged.collect()} == {(10, False, None), (20, True, "FILE_LIMIT_EXCEEDED")}


def test_job_files_and_side_files(spark, tmp_path):
    good = "123e4567-e89b-12d3-a456-426614174000"
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / f"{good}.json").write_text(json.dumps({"id": good, "status": "queued"}))
    (tmp_path / "jobs" / "223e4567-e89b-12d3-a456-426614174000.json").write_text("{broken")
    (tmp_path / "jobs" / "other.json").write_text(json.dumps({"id": "x", "status": "queued"}))
    assert [r.id for r in readers.read_job_files(spark, str(tmp_path / "jobs")).collect()] == [good]
    side = spark.createDataFrame([("x" + "€" * 5,), ("a" + "\x01" * 101,)], "text string")
    assert [r.clean for r in sinks.sidecars(side).collect()] == ["a"]
