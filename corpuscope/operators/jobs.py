"""Index-job queries and state (WIN-1, WIN-9 .. WIN-11, STR-2 .. STR-5, STR-7, SQL-8/9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import params as P
from corpuscope.functions.text import _c, overall_progress

ACTIVE = ("queued", "processing", "ready")
TERMINAL = ("ready", "error", "cancelled")


def seconds(n) -> Column:
    """SQL-9: an interval of ``n`` seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(n) if isinstance(n, (str, Column)) else F.lit(n))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """WIN-1: newest job per project; a tie keeps the highest id.

    ``max_by`` combines before the shuffle, so a busy project stays cheap.
    """
    newest = F.max_by(F.struct(*jobs.columns), F.struct("created_at", "job_id"))
    return jobs.groupBy("project_id").agg(newest.alias("job")).select("job.*")


def attention_first(projects: DataFrame) -> DataFrame:
    """WIN-9: pending, processing and failed first, then last touched."""
    waiting = F.col("status").isin("pending", "processing", "error")
    return projects.orderBy(F.when(waiting, 0).otherwise(1),
                            F.desc(F.coalesce("updated_at", "created_at")), "project_id")


def attention_columns() -> list[Column]:
    """WIN-9 sort keys as columns."""
    waiting = F.col("status").isin("pending", "processing", "error")
    return [F.when(waiting, 0).otherwise(1).alias("attention"),
            F.coalesce("updated_at", "created_at").alias("touched_at")]


def match_uploads(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """WIN-10: ``uploads(upload_id, project_id, content_hash)`` -> job.

    The newest active job of the same project and archive is reused; of equal
    new uploads the first makes the job and the others share it.
    """
    active = jobs.filter(F.col("status").isin(*ACTIVE)).groupBy("project_id", "content_hash").agg(
        F.max_by("job_id", F.struct("created_at", "job_id")).alias("existing_job"))
    keys = uploads.groupBy("project_id", "content_hash").agg(F.min("upload_id").alias("first_upload"))
    made = F.sha2(F.concat_ws(":", "project_id", "content_hash", F.col("first_upload").cast("string")), 256)
    placed = keys.join(active, ["project_id", "content_hash"], "left").select(
        "project_id", "content_hash", "first_upload",
        F.coalesce(F.col("existing_job").cast("string"), made).alias("job_id"),
        F.col("existing_job").isNotNull().alias("reused"))
    return uploads.join(placed, ["project_id", "content_hash"]).select(
        "upload_id", "project_id", "content_hash", "job_id",
        (F.col("reused") | (F.col("upload_id") != F.col("first_upload"))).alias("reused"))


def is_stale(now: Column, stale_seconds: int = P.JOB_STALE_SECONDS) -> Column:
    return (F.col("status") == "processing") & (F.col("locked_at") < now - seconds(stale_seconds))


def claimable(jobs: DataFrame, now: Column, stale_seconds: int = P.JOB_STALE_SECONDS) -> DataFrame:
    """WIN-11: due or stale jobs, ordered by ``next_run_at``."""
    due = (F.col("status") == "queued") & (F.col("next_run_at") <= now)
    return jobs.filter(due | is_stale(now, stale_seconds)).orderBy("next_run_at", "job_id")


def requeue_stale(jobs: DataFrame, now: Column, stale_seconds: int = P.JOB_STALE_SECONDS) -> DataFrame:
    """STR-4 (and SQL-8): the next snapshot with stale leases back in the queue."""
    stale = F.coalesce(is_stale(now, stale_seconds), F.lit(False))
    return jobs.withColumns({
        "status": F.when(stale, "queued").otherwise(F.col("status")),
        "next_run_at": F.when(stale, now).otherwise(F.col("next_run_at")),
        "locked_at": F.when(~stale, F.col("locked_at")),
        "updated_at": F.when(stale, now).otherwise(F.col("updated_at")),
    })


def complete_if_processing(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """STR-2: ``done(job_id)`` become ready only from processing."""
    marked = jobs.join(done.select("job_id").distinct().withColumn("done", F.lit(True)), "job_id", "left")
    finish = F.coalesce(F.col("done"), F.lit(False)) & (F.col("status") == "processing")
    return marked.withColumns({
        "status": F.when(finish, "ready").otherwise(F.col("status")),
        "progress_percent": F.when(finish, 100).otherwise(F.col("progress_percent")),
        "locked_at": F.when(~finish, F.col("locked_at")),
        "updated_at": F.when(finish, now).otherwise(F.col("updated_at")),
    }).drop("done")


def backoff_seconds(attempts) -> Column:
    """STR-3: 60, 120, ... -- attempts already counts the failed try."""
    return (F.pow(F.lit(2), _c(attempts)) * P.BACKOFF_BASE_SECONDS).cast("long")


def after_failure(jobs: DataFrame, now: Column) -> DataFrame:
    """STR-3: outcome of a failure for every given job.

    Attempts left: back in the queue with backoff.  None left: a processing
    job ends in error and its project's index is purged.
    """
    attempts, limit = F.coalesce("attempts", F.lit(1)), F.coalesce("max_attempts", F.lit(P.JOB_MAX_ATTEMPTS))
    retry = (F.col("status") != "cancelled") & (attempts < limit)
    failed = (F.col("status") == "processing") & ~retry
    return jobs.select(
        "job_id", "project_id",
        F.when(retry, "queued").when(failed, "error").otherwise(F.col("status")).alias("status"),
        F.when(retry, now + seconds(backoff_seconds(attempts))).otherwise(F.col("next_run_at")).alias("next_run_at"),
        failed.alias("purge"))


def latest_progress(events: DataFrame) -> DataFrame:
    """STR-5: ``events(job_id, event_id, ts, percent)`` -> progress and lease."""
    last = F.max_by(F.struct("percent", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("last")).select(
        "job_id", overall_progress("last.percent").alias("progress_percent"), F.col("last.ts").alias("locked_at"))


def cancel_guard(cancels: DataFrame, jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """STR-7: late cancels that may still move their project to ``error``.

    Not when the project is ready, and only for the project's latest job.
    """
    latest = latest_jobs(jobs).select("project_id", F.col("job_id").alias("latest_job"))
    return cancels.join(projects.select("project_id", "status"), "project_id").join(
        latest, "project_id", "left").select(
        "project_id", "job_id",
        ((F.col("status") != "ready") & (F.col("latest_job").isNull() | (F.col("latest_job") == F.col("job_id"))))
        .alias("apply"))
