"""Job records as an append-only log of changes: the latest one of each id is its record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import remove


class JobLog:
    """A folder of Parquet partitions batch=<number>, each the changes of one batch: whole records, and deleted where the record ends.

    Writing a batch replaces the partition of its number and nothing else, so it takes as long as its changes are many, and a batch that is written
    again leaves the same log. One writer at a time; a batch's number is that of the stream, which rises. Readers that start while compact
    runs may have to start again, as it replaces the partition that it folds the others into.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.schema = f"{schema}, deleted boolean, batch long"

    def batches(self) -> list[int]:
        """The numbers of the batches that there are changes of."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def changes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.batches() else self.spark.createDataFrame([], self.schema)

    def _latest(self, changes: DataFrame) -> DataFrame:
        row = F.struct(*self.columns, "deleted", "batch")
        return changes.groupBy("id").agg(F.max_by(row, "batch").alias("r")).select("r.*")

    def read(self, before: int | None = None) -> DataFrame:
        """The records as they are, or were before a batch."""
        changes = self.changes() if before is None else self.changes().where(F.col("batch") < before)
        return self._latest(changes).where("NOT deleted").select(*self.columns)

    def write(self, batch: int, changes: DataFrame) -> None:
        """changes (a record's columns, and deleted) as those of a batch, one row for an id at most."""
        rows = changes.select(*self.columns, F.coalesce("deleted", F.lit(False)).alias("deleted"), F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def delete(self, batch: int, job_ids: DataFrame) -> None:
        """Ends the records of job_ids (id); ids that aren't there don't matter."""
        self.write(batch, self.read(before=batch).join(job_ids.select("id").distinct(), "id", "left_semi").withColumn("deleted", F.lit(True)))

    def compact(self, upto: int) -> None:
        """Folds the batches up to a number into the last of them. What ended stays told as long as an older change of it may be there: a deletion
        goes when it was folded once before. A run that was broken off leaves a log that reads the same."""
        old = [b for b in self.batches() if b <= upto]
        if len(old) < 2:
            return
        first, last = old[0], old[-1]
        latest = self._latest(self.changes().where(F.col("batch") <= last)).where(~F.col("deleted") | (F.col("batch") > first))
        folder = f"{self.path}/_folded"
        latest.drop("batch").write.mode("overwrite").parquet(folder)  # what is read can't be replaced at the same time
        kept = self.spark.read.schema(self.schema.rpartition(",")[0]).parquet(folder)
        self.write(last, kept)
        for b in old[:-1]:
            remove(self.spark, f"{self.path}/batch={b}")
        remove(self.spark, folder)
