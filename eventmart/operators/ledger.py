"""The job ledger: an append-only table of file events and its views (LED-*, AGG-23, RSH-03, JON-06/07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.store import read_parquet_if_any

STATUSES = ["completed", "failed", "processing"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All file events; empty when no ledger exists yet. An unreadable part is an error."""
    found = read_parquet_if_any(spark, path, S.LEDGER_EVENTS)
    return spark.createDataFrame([], S.LEDGER_EVENTS) if found is None else found


def append(events: DataFrame, path: str) -> None:
    names = [f.name for f in S.LEDGER_EVENTS.fields]
    events.select(*[F.col(f.name).cast(f.dataType) for f in S.LEDGER_EVENTS.fields]).select(*names).write.mode("append").parquet(path)


def event(files: DataFrame, status: str, seq: int, row_count=None, error=None) -> DataFrame:
    """One event per file (columns file_hash, file_name, file_type, path) (LED-02, LED-03)."""
    return files.select(
        "file_hash", "file_name", "file_type",
        F.lit(status).alias("status"),
        (F.lit(None) if row_count is None else row_count).cast("long").alias("row_count"),
        (F.lit(None) if error is None else error).cast("string").alias("error_message"),
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")).alias("event_ts"),
        F.lit(seq).cast("long").alias("event_seq"),
        "path",
    )


def state(events: DataFrame) -> DataFrame:
    """Current state of every file (LED-04).

    The name, type and creation time are those of the first event since the last
    deletion, status and error those of the latest; the row count is kept from the
    last completion, and attempts count the starts. The id is taken from the hash, so
    it does not depend on the order of events. Everything is an aggregate per file:
    a file with very many events is reduced in the tasks that read them.
    """
    order = F.struct("event_ts", "event_seq")
    deleted = F.col("status") == "deleted"
    cut = events.filter(deleted).groupBy("file_hash").agg(F.max(order).alias("_cut"))
    live = events.filter(~deleted).join(cut, "file_hash", "left")
    live = live.filter(F.col("_cut").isNull() | (order > F.col("_cut")))

    def latest(column, status=None):
        when = order if status is None else F.when(F.col("status").isin(*status), order)
        return F.max_by(column, when)

    ended = F.when(F.col("status").isin("completed", "failed"), F.col("event_ts"))
    per_file = live.groupBy("file_hash").agg(
        F.min_by(F.struct("file_name", "file_type"), order).alias("_origin"),
        latest(F.struct("status", "error_message")).alias("_now"),
        F.coalesce(latest("row_count", ["completed"]), F.lit(0)).alias("row_count"),
        F.min("event_ts").alias("created_at"),
        F.max(ended).alias("completed_at"),
        F.coalesce(latest("path", ["processing"]), latest("path")).alias("retry_path"),
        F.greatest(F.count_if(F.col("status") == "processing"), F.lit(1)).cast("long").alias("attempts"),
    )
    return per_file.select(
        F.conv(F.substring("file_hash", 1, 15), 16, 10).cast("long").alias("id"),
        "file_hash",
        F.col("_origin.file_name").alias("file_name"),
        F.col("_origin.file_type").alias("file_type"),
        F.col("_now.status").alias("status"),
        "row_count",
        F.when(F.col("_now.status") == "failed", F.col("_now.error_message")).alias("error_message"),
        "created_at", "completed_at", "retry_path", "attempts",
    )


def processed_hashes(jobs: DataFrame) -> DataFrame:
    """Hashes of the files that need no further work (JON-06)."""
    return jobs.filter(F.col("status") == "completed").select("file_hash")


def unprocessed(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files whose content was not completed before (JON-06)."""
    return files.join(processed_hashes(jobs), "file_hash", "left_anti")


def newest_first(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Job history, latest first; the last ten on the history page (LED-05, SRT-07)."""
    ordered = jobs.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def failed_jobs(jobs: DataFrame) -> DataFrame:
    return newest_first(jobs.filter(F.col("status") == "failed"))


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)


def deletions(jobs: DataFrame, seq: int, status: str | None = None, job_id: int | None = None) -> DataFrame:
    """Tombstone events for one job or all jobs of a status; stored records stay (LED-06)."""
    if job_id is not None:
        jobs = jobs.filter(F.col("id") == job_id)
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    return event(jobs.withColumn("path", F.col("retry_path")), "deleted", seq)


def retry_candidates(jobs: DataFrame, hashes: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Failed jobs, optionally only those with the given hashes or file names (LED-07, JON-07)."""
    found = failed_jobs(jobs)
    if hashes is not None:
        found = found.join(hashes.select("file_hash").distinct(), "file_hash", "left_semi")
    if names is not None:
        found = found.join(names.select("file_name").distinct(), "file_name", "left_semi")
    return found


def statistics(jobs: DataFrame) -> DataFrame:
    """Jobs by status and rows written, 0 for an empty ledger (AGG-23)."""
    def counted(status):
        return F.count_if(F.col("status") == status).alias(f"{status}_jobs")

    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *[counted(s) for s in STATUSES],
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
    )


def by_type(jobs: DataFrame) -> DataFrame:
    """File types as rows, statuses as columns (RSH-03)."""
    return jobs.groupBy("file_type").pivot("status", STATUSES).agg(F.count(F.lit(1))).na.fill(0, STATUSES)
