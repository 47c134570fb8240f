"""The life of jobs as streams: requests and arrivals merged into the job log batch by batch, and a state for each job that expires by event time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from ..config import Limits, limits_from_env
from ..operators.jobs import FINISHED, OPEN, RECORD_SCHEMA, ROOM_BROADCAST, admitted, dispatched, expire_stale, is_past_retention, new_jobs
from ..sources.joblog import JobLog
from ..sources.readers import parsed_requests

#: What a client is told whose job the queue has no room for, and whose request isn't valid. Fixed values.
QUEUE_FULL, INVALID = (503, "JobQueueFullError"), (400, "Invalid request")


def tick_ms(spark: SparkSession, path: str, batch: int, clock: Callable[[], int]) -> int:
    """The time of a batch: the clock's when it first ran, kept under path, so that a batch that runs again decides as it did."""
    place = f"{path.rstrip('/')}/batch={batch}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.range(1).select(F.lit(clock()).cast("long").alias("now_ms")).coalesce(1).write.mode("overwrite").parquet(place)
    return spark.read.schema("now_ms long").parquet(place).first()["now_ms"]


def sink_batch(rows: DataFrame, path: str, batch: int) -> None:
    """rows as what a batch adds to a folder: run again, it replaces its own partition and no other."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def merge_arrivals(log: JobLog, batch: int, arrivals: DataFrame, now_ms: int, limits: Limits = Limits(), rejections: str | None = None) -> None:
    """One tick: maintenance, then new jobs as far as the queue has room, then the next ones start. Only records that change are written.

    What a batch decides depends on the log before it, on its arrivals and on now_ms, so that one that runs again writes the same, to the log and to
    rejections (id, http_status, error, at_ms): jobs that the queue has no room for have no record.
    """
    before = log.read(before=batch)
    aged = expire_stale(before, now_ms, limits.jobs_stale_ms).withColumn("deleted", is_past_retention(now_ms, limits.jobs_retention_ms))
    open_ = aged.where("NOT deleted").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "processing").alias("processing")).first()
    fresh = arrivals.dropDuplicates(["id"]).join(before.select("id"), "id", "left_anti")
    told = admitted(fresh, open_.queued, limits.jobs_max_queue)
    if rejections:
        status, error = QUEUE_FULL
        sink_batch(told.where("NOT accepted").select("id", F.lit(status).alias("http_status"), F.lit(error).alias("error"), F.lit(now_ms).cast("long").alias("at_ms")), rejections, batch)
    now = F.lit(now_ms).cast("long")
    room = told.where("accepted").withColumns({"status": F.lit("queued"), "updated_ms": now, "changed": F.lit(True), "deleted": F.lit(False)})
    old = aged.withColumn("changed", F.col("expired_now") | F.col("deleted"))
    every = old.select(*log.columns, "changed", "deleted").unionByName(room.select(*log.columns, "changed", "deleted"))
    starts = dispatched(every.where("NOT deleted"), max(0, limits.jobs_max_concurrency - open_.processing)).select("id", F.lit(True).alias("starts"))
    if limits.jobs_max_concurrency <= ROOM_BROADCAST:
        starts = F.broadcast(starts)
    after = every.join(starts, "id", "left").withColumn("starts", F.coalesce("starts", F.lit(False)))
    begun = {"status": F.when(F.col("starts"), "processing").otherwise(F.col("status"))} | {c: F.when(F.col("starts"), now).otherwise(F.col(c)) for c in ("started_ms", "updated_ms")}
    log.write(batch, after.where("changed OR starts").withColumns(begun))


def job_stream(spark: SparkSession, arrivals_path: str, log_path: str, checkpoint: str, limits: Limits | None = None, clock: Callable[[], int] | None = None, once: bool = False, rejections: str | None = None) -> StreamingQuery:
    """Job files that arrive in a folder, merged into the job log; the checkpoint makes the queue survive a restart. Rejections are partitioned by batch.
    Without limits those of the environment hold."""
    limits = limits or limits_from_env()
    log = JobLog(spark, log_path, RECORD_SCHEMA)
    arrivals = spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", 1000).json(arrivals_path)

    def each(rows: DataFrame, batch: int) -> None:
        merge_arrivals(log, batch, rows, tick_ms(spark, f"{checkpoint}-ticks", batch, clock or _clock), limits, rejections)

    return _started(arrivals, each, checkpoint, limits, once)


def merge_requests(log: JobLog, batch: int, requests: DataFrame, now_ms: int, host: str, quarantine: str, rejections: str, limits: Limits = Limits()) -> None:
    """A batch of requests (source_file, value: JSON) into three sinks: jobs of valid ones into the log, invalid ones into quarantine (source_file,
    http_status, error, issues), those that the queue has no room for into rejections. A request is valid if all its messages are.

    A job's id is made of the request's place, so that a batch that runs again gives the same; each sink holds what the batch gave it once.
    """
    parsed = parsed_requests(requests)
    status, error = INVALID
    told = parsed.groupBy("source_file").agg(F.count_if(F.size("issues") > 0).alias("wrong"), F.array_sort(F.flatten(F.collect_list("issues"))).alias("issues"))
    bad = told.where("wrong > 0").select("source_file", F.lit(status).alias("http_status"), F.lit(error).alias("error"), "issues")
    sink_batch(bad, quarantine, batch)
    good = requests.join(told.where("wrong = 0").select("source_file"), "source_file", "left_semi")
    record = new_jobs(good.select("source_file", F.col("value").alias("request")), now_ms, host, job_id=request_id(F.col("source_file")))
    merge_arrivals(log, batch, record, now_ms, limits, rejections)


def request_id(place: Column) -> Column:
    """An id of a job's form that a request's place always gives."""
    h = F.sha2(place, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def request_stream(spark: SparkSession, requests_path: str, log_path: str, checkpoint: str, host: str, quarantine: str, rejections: str, limits: Limits | None = None, clock: Callable[[], int] | None = None, once: bool = False) -> StreamingQuery:
    """Requests that arrive as JSON files in a folder, as merge_requests has it. Ended at any point, also between two sinks, and started again, it
    goes on where it was: the batch runs again, with the time that it had. Without limits those of the environment hold."""
    limits = limits or limits_from_env()
    log = JobLog(spark, log_path, RECORD_SCHEMA)
    arrived = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", 1000).text(requests_path).select(F.input_file_name().alias("source_file"), "value")

    def each(rows: DataFrame, batch: int) -> None:
        merge_requests(log, batch, rows, tick_ms(spark, f"{checkpoint}-ticks", batch, clock or _clock), host, quarantine, rejections, limits)

    return _started(arrived, each, checkpoint, limits, once)


def _clock() -> int:
    return int(time.time() * 1000)


def _started(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, limits: Limits, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{limits.maintenance_seconds} seconds")).start()


class JobFollower(StatefulProcessor):
    """The state of one job, and a timer: an open job expires when it isn't heard of for stale_ms, a finished one is forgotten after retention_ms."""

    def __init__(self, stale_ms: int, retention_ms: int):
        self.stale_ms, self.retention_ms = stale_ms, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "status string, at_ms long")

    def _keep(self, status: str, at: int, watermark: int) -> None:
        self.seen.update((status, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at + (self.stale_ms if status in OPEN else self.retention_ms), watermark + 1))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        status, at = self.seen.get() if self.seen.exists() else ("", -1)
        if status not in FINISHED:
            ends = last = None  # the first of what finishes it, else the last of all, in one pass over a batch's changes in any order
            for seen in ((r["at_ms"], r["status"]) for r in rows if r["at_ms"] >= at):
                last = seen if last is None else max(last, seen)
                if seen[1] in FINISHED:
                    ends = seen if ends is None else min(ends, seen)
            at, status = ends or last or (at, status)
        self._keep(status, at, timerValues.getCurrentWatermarkInMs())
        yield Row(id=key[0], status=status, at_ms=at)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        status, at = self.seen.get()
        if status in OPEN:
            at += self.stale_ms
            self._keep("expired", at, timerValues.getCurrentWatermarkInMs())
            yield Row(id=key[0], status="expired", at_ms=at)
        else:
            self.seen.clear()
            yield Row(id=key[0], status="deleted", at_ms=at + self.retention_ms)

    def close(self) -> None:
        pass


#: Keeps state on the executors' disks and in the checkpoint; the only one that keeps timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow_jobs(changes: DataFrame, stale_ms: int = Limits.jobs_stale_ms, retention_ms: int = Limits.jobs_retention_ms, lateness: str = "10 minutes") -> DataFrame:
    """(id, status, at_ms) after each batch of changes (id, status, at: timestamp): a finished job stays so, an open one that isn't heard of for
    stale_ms of event time expires, and one that has been finished for retention_ms is told to be deleted and leaves no state.

    So the state holds the jobs of the retention time, however long the stream runs. Changes later than lateness are left out. The session's state
    store becomes the one that has timers.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    seen = changes.withWatermark("at", lateness).withColumn("at_ms", F.unix_millis("at"))
    return seen.groupBy("id").transformWithState(JobFollower(stale_ms, retention_ms), "id string, status string, at_ms long", "Update", "EventTime")


def hourly_counts(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", lateness: str = "1 hour") -> DataFrame:
    """Events of each kind in each hour, of a stream or a table."""
    window = F.window(time_col, "1 hour")
    return events.withWatermark(time_col, lateness).groupBy(window.alias("w"), kind_col).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour_start"), kind_col, "n")


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stream of a Parquet table's files, be it one file of the folder or a folder of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_once(counts: DataFrame, path: str) -> DataFrame:
    """The rows of an aggregating stream when it has read all that is there, written to path by the executors and read again."""
    spark = counts.sparkSession
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows")
    query = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/rows")
