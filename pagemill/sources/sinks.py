"""Sinks: texts of conversations as files that tasks name, and side files."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import js_length, sanitize_text

#: A conversation's id becomes a folder, so it may hold nothing that leads elsewhere.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def write_texts(texts: DataFrame, path: str, run_ms: int) -> None:
    """The text of each conversation of texts (conversation_id, text) as {conversation}/{conversation}-{run_ms}.txt under path; rows with an unsafe id
    aren't written. Of a conversation's further rows the names end in -1, -2 and so on."""
    safe = texts.where(F.col("conversation_id").rlike(SAFE_ID))
    k = F.row_number().over(Window.partitionBy("conversation_id").orderBy("text")) - 1
    more = F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise("")
    c = F.col("conversation_id")
    write_files(safe.select(F.concat(c, F.lit("/"), c, F.lit(f"-{run_ms}"), more, F.lit(".txt")).alias("name"), "text"), path)


def write_files(files: DataFrame, path: str) -> None:
    """files (name, text) as files of UTF-8 text under path, written by tasks under their names; a null text is empty. Names must be safe and differ."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", F.coalesce("text", F.lit("")).alias("text")).write.format(NamedFiles.name()).mode("append").save(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class NamedFiles(DataSource):
    """A sink of text files whose names are a column."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FileWriter(DataSourceWriter):
    """Each task writes its files beside their places and moves each there when it is whole, so that a task that failed leaves no part of a text under
    its name, and one that runs again replaces its own. When the job fails, what tasks tell to have written goes."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = opened(self.path)
        done: list[str] = []
        for row in rows:
            place = f"{root}/{row['name']}"
            folder = place.rpartition("/")[0]
            draft = f"{folder}/.{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            try:
                with system.open_output_stream(draft) as out:
                    out.write(row["text"].encode())
                system.move(draft, place)
            except BaseException:
                with contextlib.suppress(OSError):
                    system.delete_file(draft)
                raise
            done.append(row["name"])
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Nothing is left to do: every file has its name."""

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for message in messages:
            for name in message.files if message else ():
                with contextlib.suppress(OSError):
                    system.delete_file(f"{root}/{name}")


def sidecars(texts: DataFrame, text: str = "text", more_than: int = 100) -> DataFrame:
    """Sanitized texts that lost more than so many characters."""
    clean = texts.withColumn("clean", sanitize_text(F.col(text)))
    return clean.where(js_length(F.col(text)) - js_length(F.col("clean")) > more_than)
