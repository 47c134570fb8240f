"""Extractors: bytes of a file to text, each a small function that tasks call; engines that live elsewhere are given by the caller."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..operators.messages import TIMEOUT_SECONDS, timeout_error
from .deadline import Overdue, overlapped

Extractor = Callable[[bytes], str]
#: Rows of workbooks that a task gives at once; the rows of one workbook stay together.
TOGETHER = 5000
#: Texts of files that a task gives at once.
FILES_TOGETHER = 1000
Rows = Iterator[tuple[int, str, int, list[str]]]


def plain_text(content: bytes) -> str:
    """UTF-8, with U+FFFD for what isn't."""
    return content.decode("utf-8", errors="replace")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_text(content: bytes) -> str:
    """The paragraphs of a word-processing document, an empty line between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in (e for e in root.iter() if _local(e.tag) == "p"):
        marks = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
        out.append("".join(marks[_local(e.tag)](e) for e in p.iter() if _local(e.tag) in marks))
    return "\n\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


#: Number formats that workbooks name by number. Fixed values.
FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 46: "h:mm:ss", 49: "@",
}
_IN_DATES = re.compile(r"yyyy|yy|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s|am/pm", re.IGNORECASE)
_DATE_PARTS = {"yyyy": "%Y", "yy": "%y", "mmmm": "%B", "mmm": "%b", "dddd": "%A", "ddd": "%a"}


def _as_date(number: float, code: str) -> str:
    """Days since the end of 1899 in a date format; m is a minute after hours or before seconds."""
    at = datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400))
    half = "am/pm" in code.lower()
    marks = [m.group().lower() for m in _IN_DATES.finditer(code)]
    out, end = [], 0
    for k, m in enumerate(_IN_DATES.finditer(code)):
        mark = marks[k]
        minute = mark in ("m", "mm") and (k and marks[k - 1] in ("h", "hh") or k + 1 < len(marks) and marks[k + 1] in ("s", "ss"))
        value = {"m": at.minute if minute else at.month, "d": at.day, "h": (at.hour - 1) % 12 + 1 if half else at.hour, "s": at.second}.get(mark[0], 0)
        told = "AM" if at.hour < 12 else "PM"
        out += [code[end : m.start()], told if mark == "am/pm" else at.strftime(_DATE_PARTS[mark]) if mark in _DATE_PARTS else f"{value:0{len(mark)}d}"]
        end = m.end()
    return "".join([*out, code[end:]])


def formatted(value: str, code: str | None) -> str:
    """A number as its cell shows it: in general with ten digits at most, as a date, a percentage or with so many decimals."""
    try:
        number = float(value)
    except ValueError:
        return value
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|_.|\*.', "", (code or "").split(";")[0]).replace("\\", "").strip()
    if plain in ("", "@") or plain.lower() == "general":
        if number and not 1e-4 <= abs(number) < 1e11:
            mantissa, power = f"{number:.5E}".split("E")
            return f"{mantissa.rstrip('0').rstrip('.')}E{power}"
        return f"{number:.10g}" if number % 1 else str(int(number))
    if re.search(r"[ymdhs]", plain, re.IGNORECASE) and not re.search(r"[0#]", plain):
        return _as_date(number, plain)
    number *= 100 if "%" in plain else 1
    decimals = len(m[1]) if (m := re.search(r"\.([0#]+)", plain)) else 0
    if re.search(r"E\+", plain, re.IGNORECASE):
        return f"{number:.{decimals}E}"
    return f"{number:{',' if ',' in plain else ''}.{decimals}f}" + "%" * ("%" in plain)


def _cell_formats(z: zipfile.ZipFile) -> list[str | None]:
    """The number format of each style that cells name."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): e.get("formatCode") for e in root.iter() if _local(e.tag) == "numFmt"}
    cells = next((e for e in root if _local(e.tag) == "cellXfs"), ())
    return [own.get(k, FORMATS.get(k)) for k in (int(x.get("numFmtId") or 0) for x in cells)]


def xlsx_rows(content: bytes) -> Rows:
    """(sheet index, sheet, row index, cells as they are shown) of a workbook; blank cells are empty, and rows are as wide as the widest of the sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared, formats = [], _cell_formats(z)
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        for index, sheet in enumerate(sheets):
            target = targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id" and k != "sheetId")]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            rows = []
            for row in (e for e in root.iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(e for e in row if _local(e.tag) == "c"):
                    parts = {_local(e.tag): e for e in c}
                    value = parts["v"].text or "" if "v" in parts else ""
                    kind = c.get("t")
                    if kind == "s":
                        value = shared[int(value)] if value else ""
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind in (None, "n") and value:
                        style = int(c.get("s") or 0)
                        value = formatted(value, formats[style] if style < len(formats) else None)
                    cells[_column(c.get("r")) if c.get("r") else k] = value
                rows.append(cells)
            width = max((max(r, default=-1) + 1 for r in rows), default=0)
            for k, r in enumerate(rows):
                yield index, sheet.get("name"), k, [r.get(i, "") for i in range(width)]


def xlsx_text(content: bytes) -> str:
    """A workbook as one text: what operators.sheets gives of its rows, for a file that is read among others."""
    sheets: dict[str, list[list[str]]] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(e.tag) == "sheet":
                sheets[e.get("name")] = []
    for _, sheet, _, cells in xlsx_rows(content):
        if any(c.strip() for c in cells):
            sheets[sheet].append(cells)
    total = sum(len(cells) for rows in sheets.values() for cells in rows)
    head = f"=== ARQUIVO EXCEL ===\nResumo: Planilha Excel com {len(sheets)} aba(s): {', '.join(sheets)}\nTotal de abas: {len(sheets)}\nTotal de células: {total}\n\n"
    body = (f"=== ABA {k}: {name} ===\n" + "\n".join("\t".join(cells) for cells in rows) + "\n\n" for k, (name, rows) in enumerate(sheets.items(), 1))
    return head + "".join(body)


def absent(kind: str) -> Extractor:
    def extract(content: bytes) -> str:
        raise RuntimeError(f"no {kind} engine is configured")

    return extract


def registry(**engines: Extractor) -> dict[str, Extractor]:
    """Extractors by the names that routing gives. Engines for pdf, image, audio and doc files come from the caller; without one a
    file of that kind gets an error and the others aren't affected."""
    own: dict[str, Extractor] = {"txt": plain_text, "docx": docx_text, "xlsx": xlsx_text}
    return {k: absent(k) for k in ("pdf", "image", "audio", "doc")} | own | engines


def extract_texts(files: DataFrame, extractors: dict[str, Extractor], clean: bool = True, limits: Mapping[str, float] | None = TIMEOUT_SECONDS) -> DataFrame:
    """(file_id, value, error, overdue) of files (file_id, extractor, content); a file that can't be read gets an error and fails nothing else.

    An extractor runs in a child process of the task that is ended after the seconds that limits has for its name: that file is overdue and has
    the error of timeout_error, the others of its task go on. A process that dies (for want of memory, by a fault in foreign code) is an error, too.
    An extractor that only waits, as one that hangs, doesn't keep its task from the other files.
    limits of None call extractors within the task itself, without a limit.
    """

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, kind, content in zip(batch["file_id"], batch["extractor"], batch["content"], strict=True):
                yield (file_id, kind), kind, (bytes(content),), limits.get(kind) if limits else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["file_id", "extractor", "value", "error", "overdue"]).astype({"overdue": "bool"})
        rows = []
        for tag, value, error in overlapped(extractors, calls(batches)):
            overdue = isinstance(error, Overdue)
            rows.append((*tag, value, None if overdue or error is None else str(error), overdue))
            if len(rows) >= FILES_TOGETHER:
                yield frame(rows)
                rows = []
        yield frame(rows)

    asked = files.where("extractor IS NOT NULL AND content IS NOT NULL").select("file_id", "extractor", "content")
    found = asked.mapInPandas(run, "file_id string, extractor string, value string, error string, overdue boolean")
    found = found.withColumn("error", F.when(F.col("overdue"), timeout_error(F.col("extractor"), limits or {})).otherwise(F.col("error"))).drop("extractor")
    return found.withColumn("value", F.when(F.col("value").isNotNull(), sanitize(F.col("value")))) if clean else found


def extract_sheets(files: DataFrame) -> DataFrame:
    """(file_id, sheet_index, sheet, row_index, cells, error) of workbooks (file_id, content). A task holds the rows of a few workbooks at a time, however many it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, (file_id, content) in enumerate(zip(batch["file_id"], batch["content"], strict=True), 1):
                try:
                    rows += [(file_id, *row, None) for row in xlsx_rows(bytes(content))]
                except Exception as e:
                    rows.append((file_id, None, None, None, None, str(e) or type(e).__name__))
                if len(rows) >= TOGETHER or k == len(batch):
                    yield pd.DataFrame(rows, columns=["file_id", "sheet_index", "sheet", "row_index", "cells", "error"])
                    rows = []

    return files.select("file_id", "content").mapInPandas(run, "file_id string, sheet_index int, sheet string, row_index int, cells array<string>, error string")
