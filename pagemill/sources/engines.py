"""Engines that live elsewhere, as functions of bytes that tasks call: what they tell of a file becomes rows of the model's tables.

A file that an engine fails on gets a row with the error and fails nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OcrKnobs
from ..functions.text import SPACES
from .deadline import Failed, Guard, Overdue
from .ladder import Rung, climb, reading_of
from .sinks import opened

#: Pages of a file in order: text, embedded images and tables of each.
PageEngine = Callable[[bytes], Iterable[tuple[str, int, int]]]
#: Whether a file's structure is sound, and its number of pages.
Probe = Callable[[bytes], tuple[bool, int]]
#: Images of pages first to last of a file that it reads ranges of.
Raster = Callable[[BinaryIO, int, int], Iterable[bytes]]
#: An attempt at an image: a table of words as tab-separated lines.
Recogniser = Callable[[bytes, Rung], str]
#: The image that a rung looks at, made of the page's; None if it can't be made.
Prepare = Callable[[bytes, Rung], bytes | None]


def _told(e: Exception) -> str:
    return str(e) or type(e).__name__


def extract_pages(files: DataFrame, engine: PageEngine) -> DataFrame:
    """(file_id, page_number, text, embedded_image_count, table_count, total_pages, error) of files (file_id, content): what page_spine and
    with_visuals join. A file without pages, or that fails, is one row without a page number."""
    names = ["file_id", "page_number", "text", "embedded_image_count", "table_count", "total_pages", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    pages = list(engine(bytes(content)))
                    rows = [(file_id, k, text, images, tables, len(pages), None) for k, (text, images, tables) in enumerate(pages, 1)]
                    rows = rows or [(file_id, None, None, None, None, 0, None)]
                except Exception as e:
                    rows = [(file_id, None, None, None, None, None, _told(e))]
                yield pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names if n.endswith(("number", "count", "pages"))})

    return files.select("file_id", "content").mapInPandas(
        run, f"file_id {files.schema['file_id'].dataType.simpleString()}, page_number long, text string, embedded_image_count long, table_count long, total_pages long, error string"
    )


#: Seconds that the native text of a file may take, its images and its tables each, and a probe. Fixed values.
TEXT_SECONDS, METADATA_SECONDS, PROBE_SECONDS = 120.0, 30.0, 10.0


def native_pages(
    files: DataFrame,
    text: Callable[[bytes], Sequence[str]],
    images: Callable[[bytes], Mapping[int, int]] | None = None,
    tables: Callable[[bytes], Mapping[int, int]] | None = None,
    text_seconds: float | None = TEXT_SECONDS,
    metadata_seconds: float | None = METADATA_SECONDS,
) -> DataFrame:
    """(file_id, page_number, text, embedded_image_count, table_count, total_pages, error) of files (file_id, content), as extract_pages has them, by
    an engine of the texts of pages and others that count images and tables by page number.

    Each call has a time limit and runs in a child process that is ended then. A file whose text fails or is late is one row with the error; images
    or tables that fail or are late are none, and the file's text stands.
    """
    names = ["file_id", "page_number", "text", "embedded_image_count", "table_count", "total_pages", "error"]
    calls = {"native PDF text extraction": text} | {k: f for k, f in (("images", images), ("tables", tables)) if f}

    def counted(guard: Guard, kind: str, content: bytes) -> Mapping[int, int]:
        try:
            return guard.call(kind, content, seconds=metadata_seconds) if kind in calls else {}
        except (Overdue, Failed):
            return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Guard(calls) as guard:
            for batch in batches:
                for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                    try:
                        pages = list(guard.call("native PDF text extraction", bytes(content), seconds=text_seconds))
                    except Overdue:
                        rows = [(file_id, *[None] * 5, f"{TEXT_ERROR}native PDF text extraction exceeded timeout of {text_seconds * 1000:.0f}ms")]
                    except Failed as e:
                        rows = [(file_id, *[None] * 5, f"{TEXT_ERROR}{e}")]
                    else:
                        seen = [counted(guard, kind, bytes(content)) for kind in ("images", "tables")]
                        rows = [(file_id, k, t, *(c.get(k, 0) for c in seen), len(pages), None) for k, t in enumerate(pages, 1)] or [(file_id, *[None] * 4, 0, None)]
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:6] if c != "text"})

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInPandas(run, f"file_id {kind}, page_number long, text string, embedded_image_count long, table_count long, total_pages long, error string")


#: How a file is told that its native text couldn't be read. Fixed value.
TEXT_ERROR = "Erro ao extrair texto do PDF: "


def probe_files(files: DataFrame, probe: Probe, seconds: float | None = PROBE_SECONDS) -> DataFrame:
    """(file_id, valid, page_count) of files (file_id, content); one that the probe fails on or is late with, is invalid and has no page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Guard({"probe": probe}) as guard:
            for batch in batches:
                rows = []
                for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                    try:
                        valid, pages = guard.call("probe", bytes(content), seconds=seconds)
                    except (Overdue, Failed):
                        valid, pages = False, 0
                    rows.append((file_id, bool(valid), int(pages)))
                yield pd.DataFrame(rows, columns=["file_id", "valid", "page_count"])

    return files.select("file_id", "content").mapInPandas(run, f"file_id {files.schema['file_id'].dataType.simpleString()}, valid boolean, page_count long")


def recognise_pages(
    chunks: DataFrame,
    raster: Raster,
    recogniser: Recogniser,
    prepare: Prepare | None = None,
    knobs: OcrKnobs = OcrKnobs(),
    seconds: float | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """(file_id, first, last, page_number, text, confidence, words, score, rung, mode, angle, attempts, failed, error) of chunks (file_id, path, first, last).

    A row for each page that something was read on: the attempt that climb takes, how many were made and how many of those failed, which are skipped.
    A chunk that fails as a whole (its file isn't there, the raster engine raises, its time is up) is one row with an error and without a page
    number; one without any text is a row with neither, so every chunk has a row. chunk_errors makes a file's outcome of these rows.

    Only paths and ranges are dealt out, by a hash of file and chunk: chunks of one file go to different tasks, and no file content is in a shuffle.
    A task opens the path itself and gives the raster engine a file to read ranges from. prepare makes the images of later rungs, only when one is
    climbed; without it those are left out. With seconds, a chunk runs in a child process that is ended then, with the error of the time limit.
    """
    angles = rotations_of(knobs.rotate_angles)

    def pages_of(path: str, first: int, last: int) -> list[tuple]:
        system, place = opened(path)
        rows = []
        with system.open_input_file(place) as file:
            for page, image in enumerate(raster(file, first, last), first):
                made: dict[tuple[str, int], bytes | None] = {("orig", 0): image}

                def look(rung: Rung, image: bytes = image, made: dict = made) -> bytes | None:
                    key = (rung.label, rung.angle)
                    if key not in made:
                        try:
                            made[key] = prepare(image, rung) if prepare else None
                        except Exception:
                            made[key] = None
                    return made[key]

                found = climb(lambda rung: reading_of(recogniser(look(rung), rung)), lambda rung: look(rung) is not None, knobs, angles)
                if found.reading and (text := found.reading.text.strip(SPACES)):
                    rows.append((page, text, found.reading.confidence, found.reading.words, found.score, found.rung.label, found.rung.mode, found.rung.angle, found.made, found.failed, None))
        return rows or [(*[None] * 10, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Guard({"chunk": pages_of}) as guard:
            for batch in batches:
                for file_id, path, first, last in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    try:
                        rows = guard.call("chunk", path, first, last, seconds=seconds)
                    except Overdue:
                        rows = [(*[None] * 10, f"OCR processing timed out after {seconds / 60:g} minutes")]
                    except Failed as e:
                        rows = [(*[None] * 10, str(e))]
                    yield pa.RecordBatch.from_arrays([pa.array([v for _ in rows], t) for v, t in ((file_id, batch.schema.types[0]), (first, pa.int64()), (last, pa.int64()))] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(_PAGE_TYPES)], names=["file_id", "first", "last", *_PAGE_NAMES])

    n = tasks or chunks.sparkSession.sparkContext.defaultParallelism
    asked = chunks.select("file_id", "path", F.col("first").cast("long"), F.col("last").cast("long")).repartition(n, "file_id", "first")
    schema = f"file_id {chunks.schema['file_id'].dataType.simpleString()}, first long, last long, page_number long, text string, confidence double, words long, score double, rung string, mode long, angle long, attempts long, failed long, error string"
    return asked.mapInArrow(run, schema)


_PAGE_NAMES = ("page_number", "text", "confidence", "words", "score", "rung", "mode", "angle", "attempts", "failed", "error")
_PAGE_TYPES = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def rotations_of(setting: str) -> list[int]:
    """The quarter turns that a comma-separated setting names, each once, in its order; rotation_angles says the same of a column."""
    numbers = (re.match(r"\s*([+-]?\d{1,9})", x) for x in setting.split(","))
    return list(dict.fromkeys(n for m in numbers if m and (n := int(m[1])) in (90, 180, 270)))
