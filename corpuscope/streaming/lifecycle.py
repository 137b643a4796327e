"""STR-2 .. STR-5 as streams: job lifecycle, lease timer and progress."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuscope import params as P
from corpuscope.functions.text import millis, overall_progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "job_id long, status string, attempts int, progress_percent int, next_run_ms long, locked_ms long, late_events long, at_ms long"
_STATE = "status string, attempts int, progress int, next_run long, locked long, late long"
_TERMINAL = ("ready", "error", "cancelled")


class JobLifecycle(StatefulProcessor):
    """Folds ``enqueue, claim, heartbeat, complete, fail, cancel, requeue``; an event behind the watermark only counts as late.

    Emits the state after every micro-batch that touched the job.  With
    ``auto_requeue`` a lease that is not renewed in time puts the job back in
    the queue when the watermark passes it.
    """

    def __init__(self, max_attempts: int, stale_ms: int, backoff_ms: int, auto_requeue: bool):
        self.max_attempts, self.stale_ms = max_attempts, stale_ms
        self.backoff_ms, self.auto_requeue = backoff_ms, auto_requeue

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        *state, late = tuple(self.job.get()) if self.job.exists() else ("none", 0, 0, None, None, 0)
        behind = batch["ms"] < timerValues.getCurrentWatermarkInMs()
        late, known, state = late + int(behind.sum()), batch[~behind], tuple(state)
        for event, ms, percent in zip(known["event"], known["ms"], known["percent"]):
            state = self.advance(state, event, int(ms), int(percent))
        self.job.update((*state, late))
        if self.auto_requeue and state[0] == "processing":
            self.handle.registerTimer(state[4] + self.stale_ms + 1)
        yield self.row(key, (*state, late), int(batch["ms"].iloc[-1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        state = tuple(self.job.get()) if self.job.exists() else None
        if state and state[0] == "processing" and state[4] + self.stale_ms < due:
            state = ("queued", state[1], state[2], due, None, state[5])
            self.job.update(state)
            yield self.row(key, state, due)
        else:
            yield pd.DataFrame()

    def advance(self, state: tuple, event: str, ms: int, percent: int) -> tuple:
        status, attempts, progress, next_run, locked = state
        running = status == "processing"
        stale = running and locked < ms - self.stale_ms
        if event == "enqueue" and status == "none":
            return "queued", attempts, progress, ms, locked
        if event == "claim" and (stale or (status == "queued" and next_run <= ms)):
            return "processing", attempts + 1, progress, next_run, ms
        if event == "heartbeat" and running:
            return status, attempts, percent, next_run, ms
        if event == "complete" and running:
            return "ready", attempts, 100, next_run, None
        if event == "cancel" and status not in ("none", *_TERMINAL):
            return "cancelled", attempts, progress, next_run, None
        if event == "fail" and status not in ("none", "cancelled"):
            if attempts < self.max_attempts:
                return "queued", attempts, progress, ms + 2 ** attempts * self.backoff_ms, None
            if running:
                return "error", attempts, progress, next_run, None
        if event == "requeue" and stale:
            return "queued", attempts, progress, ms, None
        return state

    def row(self, key, state: tuple, at_ms: int) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *state, at_ms)], columns=[c.split()[0] for c in OUTPUT.split(", ")])
        return frame.astype({"next_run_ms": "Int64", "locked_ms": "Int64"})

    def close(self) -> None:
        pass


def stream_job_states(events: DataFrame, max_attempts: int = P.JOB_MAX_ATTEMPTS,
                      stale_seconds: int = P.JOB_STALE_SECONDS, delay: str = "10 minutes",
                      auto_requeue: bool = False) -> DataFrame:
    """``events(job_id, event_id, ts, event, percent)`` as a stream -> states."""
    keyed = (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        .select("job_id", "event_id", "event", millis("ts").alias("ms"),
                F.coalesce("percent", F.lit(0)).alias("percent"), "ts")
    )
    processor = JobLifecycle(max_attempts, stale_seconds * 1000, P.BACKOFF_BASE_SECONDS * 1000, auto_requeue)
    return keyed.groupBy("job_id").transformWithStateInPandas(processor, OUTPUT, outputMode="Update", timeMode="EventTime")


def stream_progress(events: DataFrame) -> DataFrame:
    """STR-5: latest progress and lease per job (``outputMode("update")``)."""
    last = F.max_by(F.struct("percent", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("last")).select(
        "job_id", overall_progress("last.percent").alias("progress_percent"), F.col("last.ts").alias("locked_at"))
