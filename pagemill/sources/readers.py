"""Readers: staged files, requests, job records and outputs, as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import DataType, LongType, StructType

from ..config import Limits
from ..operators.jobs import JOB_ID, RECORD_SCHEMA
from ..operators.messages import download_error, validated
from .sinks import opened

#: A job's id as Python's patterns say it.
ID_NAME = re.compile(JOB_ID.replace("(?i)", "").strip("^$"), re.IGNORECASE)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON requests, an object or an array in a file, with their issues. What isn't JSON comes as a row with an issue, and so
    does a number or the like where a string is asked for: the schema alone would read it as one."""
    return parsed_requests(spark.read.text(path, wholetext=True).withColumn("source_file", F.input_file_name()))


def parsed_requests(requests: DataFrame) -> DataFrame:
    """The messages of requests (source_file, value: JSON), each with its issues, an empty array for a valid one."""
    spark = requests.sparkSession
    parsed = requests.select("source_file", "value").withColumn("v", F.try_parse_json("value"))
    bad = parsed.where("v IS NULL").select("source_file", F.lit(None).cast("variant").alias("v"), F.col("value").alias("_corrupt_record"))
    good = parsed.where("v IS NOT NULL").select("source_file", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))).alias("list_"))
    each = good.lateralJoin(spark.tvf.variant_explode(F.col("list_").outer())).select("source_file", F.col("value").alias("v"), F.lit(None).cast("string").alias("_corrupt_record"))
    told = each.unionByName(bad)
    files_of = F.try_variant_get("v", "$.body.files", "array<struct<fileId:variant,url:variant,mimeType:variant>>")
    typed = told.withColumns({"conversationId": F.try_variant_get("v", "$.conversationId", "string"), "files_": files_of})
    body = F.when(F.schema_of_variant(F.try_variant_get("v", "$.body", "variant")).startswith("OBJECT"), F.struct(F.transform("files_", _file).alias("files")))
    checked = validated(typed.withColumn("body", body))
    wrong = F.array(
        _not_a_string(F.try_variant_get("v", "$.conversationId", "variant"), F.lit("conversationId")),
    )
    of_files = F.flatten(F.transform("files_", lambda f, i: F.array(*[_not_a_string(f[c], F.concat(F.lit("files."), i.cast("string"), F.lit("." + c))) for c in ("fileId", "url", "mimeType")])))
    return checked.withColumn("issues", F.concat("issues", F.array_compact(F.concat(wrong, F.coalesce(of_files, F.array().cast("array<string>")))))).drop("v", "files_")


def _file(f: Column) -> Column:
    return F.struct(*[F.try_variant_get(f[c], "$", "string").alias(c) for c in ("fileId", "url", "mimeType")])


def _not_a_string(value: Column, name: Column) -> Column:
    return F.when(~F.schema_of_variant(value).isin("STRING", "VOID"), F.concat(name, F.lit(": not a string")))


def split_valid(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid messages, and those that go to quarantine."""
    ok = F.size("issues") == 0
    return messages.where(ok), messages.where(~ok)


def read_staged_files(spark: SparkSession, path: str, max_bytes: int = Limits.max_file_bytes, glob: str = "*") -> DataFrame:
    """path, length, content and code of staged files. The content of a file above the limit isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    above = (F.lit(max_bytes) > 0) & (F.col("length") > max_bytes)
    return files.select("path", "length", F.when(~above, F.col("content")).alias("content"), F.when(above, "FILE_LIMIT_EXCEEDED").alias("code"))


def with_staged_content(files: DataFrame, staged: DataFrame) -> DataFrame:
    """files (url) with the content of the staged file of that path; error where there is none, code where it is too large."""
    by = staged.select(F.col("path").alias("staged_path"), "length", "content", "code")
    joined = files.join(by, F.col("url") == F.col("staged_path"), "left")
    fetched = download_error(F.when(F.col("staged_path").isNull(), F.lit(404)), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return joined.withColumn("error", F.coalesce(fetched, F.when(F.col("code").isNotNull(), "Arquivo acima do limite configurado"))).drop("staged_path")


def read_job_files(spark: SparkSession, path: str) -> DataFrame:
    """Job records of a folder with a JSON file for each job; files that aren't named by a job id, or can't be read, are left out.

    where("id = '...'") and where(id in a list) read the files of those ids and don't list the folder, however many jobs it holds.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JobFiles)
    return spark.read.format(JobFiles.name()).schema(RECORD_SCHEMA).load(path)


class JobFiles(DataSource):
    """A source of job records, one JSON file each."""

    @classmethod
    def name(cls) -> str:
        return "job_files"

    def reader(self, schema: StructType) -> JobReader:
        return JobReader(self.options["path"], schema)


@dataclass
class Names(InputPartition):
    names: list[str]


class JobReader(DataSourceReader):
    """Partitions are lists of files. An id that is asked for by a filter is the name of its file."""

    #: Files of a partition, and partitions at most.
    FILES, PARTITIONS = 200, 10_000

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.ids = path.rstrip("/"), schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("id",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = asked if self.ids is None else self.ids & asked
            yield f  # Spark still compares, as a file may hold another id than its name says

    def partitions(self) -> list[Names]:
        if self.ids is not None:
            names = sorted(x for x in self.ids if isinstance(x, str) and re.fullmatch(ID_NAME, x))
        else:
            system, root = opened(self.path)
            found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
            names = sorted(x.base_name.removesuffix(".json") for x in found if x.is_file and x.base_name.endswith(".json") and re.fullmatch(ID_NAME, x.base_name.removesuffix(".json")))
        size = max(self.FILES, -(-len(names) // self.PARTITIONS))
        return [Names(names[k : k + size]) for k in range(0, len(names), size)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        system, root = opened(self.path)
        for name in partition.names:
            try:
                with system.open_input_file(f"{root}/{name}.json") as file:
                    record = json.loads(file.read())
                if isinstance(record, dict) and record.get("id") is not None:
                    yield tuple(self._value(record.get(f.name), f.dataType) for f in self.schema)
            except (OSError, ValueError):
                continue  # not there any more, or unreadable

    @staticmethod
    def _value(value, kind: DataType):
        """As the schema has it: JSON within a text column as text; a value of another kind makes the file unreadable."""
        if value is None or isinstance(kind, LongType):
            return None if value is None else int(value)
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def list_outputs(spark: SparkSession, path: str) -> DataFrame:
    """conversation_id and file name of the texts in a folder of outputs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path")
    parts = F.split("path", "/")
    return files.select(F.regexp_replace(F.element_at(parts, -2), "^conversation_id=", "").alias("conversation_id"), F.element_at(parts, -1).alias("file_name"))
