"""The life of processing jobs as DataFrames of job records: dispatch, updates, expiry, retention and views. now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Limits

#: Fixed values.
STATUSES = ("queued", "processing", "completed", "failed", "expired")
OPEN, FINISHED = ("queued", "processing"), ("completed", "failed", "expired")
JOB_ID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
TIMEOUT_WORDS = "excedeu o tempo limite"

RECORD_SCHEMA = (
    "id string, type string, status string, request string, host string, protocol string, result string, error string, "
    "created_ms long, updated_ms long, started_ms long, finished_ms long"
)


#: Room for so many jobs is broadcast.
ROOM_BROADCAST = 100_000


def valid_job_id(job_id: Column) -> Column:
    return job_id.rlike(JOB_ID)


def is_stale(now_ms: int, stale_ms: int) -> Column:
    """Open jobs whose last sign of life is older than stale_ms; exactly that old is not. One without a readable time is stale."""
    seen = F.coalesce("started_ms", "updated_ms", "created_ms")
    return F.col("status").isin(*OPEN) & ~F.coalesce(seen >= now_ms - stale_ms, F.lit(False))


def expire_stale(jobs: DataFrame, now_ms: int, stale_ms: int = Limits.jobs_stale_ms) -> DataFrame:
    """jobs with stale ones expired, and whether each just was."""
    marked = jobs.withColumn("expired_now", is_stale(now_ms, stale_ms))
    return _expire(marked, "expired_now", f"Job expirado apos {stale_ms}ms sem conclusao", now_ms)


def _expire(jobs: DataFrame, flag: str, message: str, now_ms: int) -> DataFrame:
    now = F.lit(now_ms).cast("long")
    return jobs.withColumns(
        {
            "status": F.when(F.col(flag), "expired").otherwise(F.col("status")),
            "error": F.when(F.col(flag), message).otherwise(F.col("error")),
            "finished_ms": F.when(F.col(flag), now).otherwise(F.col("finished_ms")),
            "updated_ms": F.when(F.col(flag), now).otherwise(F.col("updated_ms")),
        }
    )


def is_past_retention(now_ms: int, retention_ms: int) -> Column:
    seen = F.coalesce("finished_ms", "updated_ms")
    return F.col("status").isin(*FINISHED) & ~F.coalesce(seen >= now_ms - retention_ms, F.lit(False))


def retained(jobs: DataFrame, now_ms: int, retention_ms: int = Limits.jobs_retention_ms) -> DataFrame:
    return jobs.where(~is_past_retention(now_ms, retention_ms))


def maintain(jobs: DataFrame, now_ms: int, limits: Limits = Limits()) -> DataFrame:
    """One tick: stale jobs expire first, then what is past retention goes."""
    return retained(expire_stale(jobs, now_ms, limits.jobs_stale_ms), now_ms, limits.jobs_retention_ms)


def pruned_queue(queue: DataFrame, jobs: DataFrame, now_ms: int, stale_ms: int = Limits.jobs_stale_ms) -> DataFrame:
    """queue (job_id, position) with outcome: kept, expired (queued longer than stale_ms, by creation alone) or dropped
    (its record is missing or has left the queue)."""
    seen = queue.join(jobs.select(F.col("id").alias("job_id"), "status", "created_ms"), "job_id", "left")
    queued = F.coalesce(F.col("status") == "queued", F.lit(False))
    return seen.select("job_id", "position", F.when(queued & (now_ms - F.col("created_ms") > stale_ms), "expired").when(queued, "kept").otherwise("dropped").alias("outcome"))


def dispatched(jobs: DataFrame, slots: int = Limits.jobs_max_concurrency, key: str | None = None) -> DataFrame:
    """The queued jobs that start next, oldest first; of each key if one is given. Without a key the first slots are a top-k, not a sort of all."""
    queued = jobs.where("status = 'queued'")
    if key is None:
        return queued.orderBy("created_ms", "id").limit(slots)
    return queued.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("created_ms", "id"))).where(F.col("rank") <= slots)


def admitted(arrivals: DataFrame, waiting: int, most: int = Limits.jobs_max_queue) -> DataFrame:
    """arrivals with accepted: those that a queue with so many waiting has room for, in order of arrival. The room is bounded, so it is a top-k."""
    room = max(0, most - waiting)
    inside = arrivals.orderBy("created_ms", "id").limit(room).select("id", F.lit(True).alias("accepted"))
    if room <= ROOM_BROADCAST:
        inside = F.broadcast(inside)
    return arrivals.join(inside, "id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def updated(jobs: DataFrame, updates: DataFrame, now_ms: int) -> DataFrame:
    """jobs with the columns of updates (id and some of status, result, error, started_ms, finished_ms) that aren't null. A job that
    has finished stays as it is, so a late completion doesn't undo an expiry."""
    fields = [c for c in updates.columns if c != "id"]
    renamed = updates.select("id", *[F.col(c).alias("new_" + c) for c in fields], F.lit(True).alias("is_update"))
    takes = F.coalesce("is_update", F.lit(False)) & ~F.col("status").isin(*FINISHED)
    joined = jobs.join(renamed, "id", "left").withColumn("takes", takes)
    joined = joined.withColumns({c: F.when(F.col("takes"), F.coalesce("new_" + c, c)).otherwise(F.col(c)) for c in fields})
    joined = joined.withColumn("updated_ms", F.when(F.col("takes"), F.lit(now_ms).cast("long")).otherwise(F.col("updated_ms")))
    return joined.select(*jobs.columns)


def completion(error: Column) -> Column:
    """The status that a run ends in: an error about its time limit is an expiry."""
    return F.when(error.isNull(), "completed").when(error.contains(TIMEOUT_WORDS), "expired").otherwise("failed")


def status_counts(jobs: DataFrame, *keys: str) -> DataFrame:
    return jobs.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias("n_" + s) for s in STATUSES])


def result_view(jobs: DataFrame) -> DataFrame:
    """What a client that asks for a job's result gets: 202 while it is open, its error if it has failed, else the result."""
    open_, bad = F.col("status").isin(*OPEN), F.col("status").isin("failed", "expired")
    return jobs.select("id", "status", F.when(open_, 202).otherwise(200).alias("http_status"), F.when(bad, F.col("error")).alias("error"), F.when(~open_ & ~bad, F.col("result")).alias("result"))


#: Names of a record's fields as clients see them. Fixed values.
RECORD_FIELDS = ("id", "type", "status", "request", "host", "protocol", "result", "error", "createdAt", "updatedAt", "startedAt", "finishedAt")


def record_json(jobs: DataFrame) -> DataFrame:
    """(id, json): each record as the JSON of its file, times in ISO 8601, without fields that are null; request and result hold JSON themselves."""

    def field(name: str) -> Column:
        if name.endswith("At"):
            return F.date_format(F.timestamp_millis(name[:-2] + "_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return F.col(name)

    own = [f for f in RECORD_FIELDS if (f[:-2] + "_ms" if f.endswith("At") else f) in jobs.columns]
    return jobs.select("id", F.to_json(F.struct(*[field(f).alias(f) for f in own])).alias("json"))


def error_json(name: Column, message: Column, stack: Column) -> Column:
    """An error as JSON: its name, message and stack; one without a name is a value."""
    return F.when(name.isNotNull(), F.to_json(F.struct(name.alias("name"), message.alias("message"), stack.alias("stack")))).otherwise(F.to_json(F.struct(F.coalesce(message, F.lit("null")).alias("value"))))


def new_jobs(requests: DataFrame, now_ms: int, host: str, protocol: str = "https", job_id: Column | None = None) -> DataFrame:
    """Queued records for requests (request: JSON), each with an id of its own. Without job_id ids differ from run to run: write the records before they
    are used twice."""
    now = F.lit(now_ms).cast("long")
    none = {c: F.lit(None).cast("string") for c in ("result", "error")} | {c: F.lit(None).cast("long") for c in ("started_ms", "finished_ms")}
    named = {"id": F.expr("uuid()") if job_id is None else job_id, "type": F.lit("process-message"), "status": F.lit("queued"), "host": F.lit(host), "protocol": F.lit(protocol), "created_ms": now, "updated_ms": now}
    return requests.withColumns(named | none).select(*[c.split()[0] for c in RECORD_SCHEMA.split(", ")])
