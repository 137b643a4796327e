"""STR-2 over a log of any shape: job events as state-to-state maps that compose.

The log is range-partitioned by (job, time), so a busy job spans many partitions. A job inside one
partition is folded there. A run that a partition edge cuts is described by a small map from the state that it may
inherit to the state that it hands on:

* ``none``, ``ready`` and ``error`` decide by status and attempts alone; ``cancelled`` stays;
* ``queued`` waits for the first claim at or after its due time, ``processing`` for the first claim or requeue after its
  lease is stale: one piece of the map for each such event, up to the event that ends the wait anyway.

Neighbouring pieces that lead to one state are one piece. The maps of a job are chained in order, one
row for each partition and piece; nothing is stepped from the driver and no job is brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope import params as P
from corpuscope.functions.text import millis
from corpuscope.session import cut_lineage

NONE = ("none", 0, 0, None, None)
#: stands for what a run inherits and does not touch
SAME = "same"

_MAP = ("seg int, edge boolean, status string, attempts int, upto long, to_status string, to_attempts int, to_progress int, "
        "to_next long, next_same boolean, to_locked long, locked_same boolean")
_NAMES = [c.split()[0] for c in _MAP.split(", ")]


class Rules:
    """The transitions of a job. A state is (status, attempts, progress, next_run, locked), times in milliseconds."""

    def __init__(self, max_attempts: int, stale_seconds: int, backoff_seconds: int = P.BACKOFF_BASE_SECONDS):
        self.max_attempts, self.stale_ms, self.backoff_ms = max_attempts, stale_seconds * 1000, backoff_seconds * 1000

    def failed(self, state: tuple, ms: int) -> tuple:
        status, attempts, progress, next_run, _ = state
        if attempts < self.max_attempts:
            return "queued", attempts, progress, ms + 2 ** attempts * self.backoff_ms, None
        return ("error", attempts, progress, next_run, None) if status == "processing" else state

    def certain(self, state: tuple, event: str, ms: int, percent: int) -> tuple | None:
        """The state after an event that needs no time of the state; None where the event leaves it or depends on one."""
        status, attempts, progress, next_run, locked = state
        if event == "enqueue":
            return ("queued", attempts, progress, ms, locked) if status == "none" else None
        if event == "fail" and status not in ("none", "cancelled"):
            after = self.failed(state, ms)
            return None if after is state else after
        if event == "cancel" and status in ("queued", "processing"):
            return "cancelled", attempts, progress, next_run, None
        if status == "processing":
            if event == "heartbeat":
                return status, attempts, percent, next_run, ms
            if event == "complete":
                return "ready", attempts, 100, next_run, None
        return None

    def timed(self, state: tuple, event: str, ms: int) -> tuple | None:
        """The state after a claim or requeue, if its time lets it act."""
        status, attempts, progress, next_run, _ = state
        if event == "claim" and status in ("queued", "processing"):
            return "processing", attempts + 1, progress, next_run, ms
        if event == "requeue" and status == "processing":
            return "queued", attempts, progress, ms, None
        return None

    def acts(self, state: tuple, ms: int) -> bool:
        status, _, _, next_run, locked = state
        return next_run <= ms if status == "queued" else locked < ms - self.stale_ms

    def advance(self, state: tuple, event: str, ms: int, percent: int) -> tuple:
        after = self.certain(state, event, ms, percent)
        if after is None:
            after = self.timed(state, event, ms)
            after = after if after is not None and self.acts(state, ms) else None
        return state if after is None else after


def fold(rules: Rules, run: list[tuple], state: tuple = NONE) -> tuple:
    """The state after all events (event, ms, percent) of a run."""
    for event, ms, percent in run:
        state = rules.advance(state, event, ms, percent)
    return state


def describe(rules: Rules, run: list[tuple]) -> list[tuple]:
    """The map of a run: (status, attempts, upto, state after it).

    ``attempts`` of ``max_attempts`` stands for that many and more. ``upto`` bounds the due time of ``queued`` (inclusive) or the
    lease of ``processing`` (exclusive) and is None for the rest. States that meet are carried on as one.
    """
    live: dict[tuple, list] = {NONE: [("none", 0, None)]}
    waiting: dict[tuple, tuple] = {}
    reached: dict[tuple, int] = {}
    for attempts in range(rules.max_attempts + 1):
        for status in ("ready", "error"):
            live[status, attempts, SAME, SAME, SAME] = [(status, attempts, None)]
        for status in ("queued", "processing"):
            waiting[status, attempts] = (status, attempts, SAME, SAME, SAME)

    for event, ms, percent in run:
        born: list[tuple] = []
        for entry, state in list(waiting.items()):
            after = rules.certain(state, event, ms, percent)
            if after is not None:
                born.append((after, (*entry, None)))
                del waiting[entry]
                continue
            after = rules.timed(state, event, ms)
            if after is not None and reached.get(entry) != ms:  # of several at one time the first acts
                reached[entry] = ms
                born.append((after, (*entry, ms if entry[0] == "queued" else ms - rules.stale_ms)))
        moved: dict[tuple, list] = {}
        for state, origins in live.items():
            moved.setdefault(rules.advance(state, event, ms, percent), []).extend(origins)
        for state, origin in born:
            moved.setdefault(state, []).append(origin)
        live = moved
    for entry, state in waiting.items():
        live.setdefault(state, []).append((*entry, None))
    rows = sorted(((*origin, state) for state, origins in live.items() for origin in origins),
                  key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
    out: list[tuple] = []
    for row in rows:  # a later piece that leads to the same state takes the earlier one in
        if out and out[-1][:2] == row[:2] and out[-1][3] == row[3]:
            out[-1] = row
        else:
            out.append(row)
    return out


def follow(rules: Rules, pieces: dict, state: tuple) -> tuple:
    """The state after a run, from the state before it: ``pieces`` maps (status, attempts) to rows in the order of ``upto``."""
    status, attempts, progress, next_run, locked = state
    if status == "cancelled":
        return state
    known = min(attempts, rules.max_attempts)
    for upto, after in pieces[status, known]:
        if upto is None or (next_run <= upto if status == "queued" else locked < upto):
            to, tries, done, due, lease = after
            return (to, tries + attempts - known, progress if done == SAME else done,
                    next_run if due == SAME else due, locked if lease == SAME else lease)
    return state


def _encoded(seg: int, edge: bool, status: str, attempts: int, upto, state: tuple) -> tuple:
    to, tries, done, due, lease = state
    return (seg, edge, status, attempts, upto, to, tries, None if done == SAME else done,
            None if due == SAME else due, due == SAME, None if lease == SAME else lease, lease == SAME)


def _value(number):
    return None if pd.isna(number) else int(number)


def _scan(rules: Rules):
    """Per partition: the final state of each job inside it, the maps of the first and the last."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, seg, run, first, out = None, 0, [], True, []

        def close(edge: bool) -> None:
            if not run:
                return
            rows = describe(rules, run) if edge else [("none", 0, None, fold(rules, run))]
            out.extend((job, *_encoded(seg, edge, *row)) for row in rows)

        for batch in batches:
            for own, part, event, ms, percent in zip(batch["job_id"], batch["seg"], batch["event"], batch["ms"], batch["percent"]):
                if run and own != job:
                    close(first)
                    run, first = [], False
                job, seg = own, int(part)
                run.append((event, int(ms), int(percent)))
            if len(out) > 10_000:
                yield _frame(out)
                out = []
        close(True)
        yield _frame(out)

    return scan


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["job_id", *_NAMES])
    return frame.astype({c: "Int64" for c in ("upto", "to_progress", "to_next", "to_locked")})


def _chain(rules: Rules):
    """The maps of one job, applied in the order of its partitions."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        state = NONE
        for _, part in rows.sort_values("seg").groupby("seg", sort=True):
            pieces: dict = {}
            part = part.sort_values("upto", na_position="last")
            for r in part.itertuples():
                after = (r.to_status, int(r.to_attempts), SAME if pd.isna(r.to_progress) else int(r.to_progress),
                         SAME if r.next_same else _value(r.to_next), SAME if r.locked_same else _value(r.to_locked))
                pieces.setdefault((r.status, int(r.attempts)), []).append((_value(r.upto), after))
            state = follow(rules, pieces, state)
        frame = pd.DataFrame([(rows["job_id"].iloc[0], *state)], columns=["job_id", "status", "attempts", "progress", "next_run", "locked"])
        return frame.astype({"next_run": "Int64", "locked": "Int64"})

    return chain


def job_states(events: DataFrame, max_attempts: int = P.JOB_MAX_ATTEMPTS, stale_seconds: int = P.JOB_STALE_SECONDS,
               partitions: int | None = None) -> DataFrame:
    """STR-2: ``events(job_id, event_id, ts, event, percent)`` -> the last state of each job, whatever share of the log it holds.

    Events of one job at one time go by event_id. ``partitions`` sets in how many the log is laid out.
    """
    rules = Rules(max_attempts, stale_seconds)
    log = events.select("job_id", "event_id", millis("ts").alias("ms"), "event", F.coalesce("percent", F.lit(0)).alias("percent"))
    order = ["job_id", "ms", "event_id"]
    spread = log.repartitionByRange(*order) if partitions is None else log.repartitionByRange(partitions, *order)
    key = log.schema["job_id"].dataType.simpleString()
    scanned = spread.sortWithinPartitions(*order).withColumn("seg", F.spark_partition_id()) \
        .mapInPandas(_scan(rules), f"job_id {key}, {_MAP}")
    scanned = cut_lineage(scanned)  # a row for each job, and the maps of two jobs a partition
    cut = scanned.filter("edge").groupBy("job_id").applyInPandas(
        _chain(rules), f"job_id {key}, status string, attempts int, progress int, next_run long, locked long")
    whole = scanned.filter("NOT edge").select(
        "job_id", F.col("to_status").alias("status"), F.col("to_attempts").alias("attempts"), F.col("to_progress").alias("progress"),
        F.col("to_next").alias("next_run"), F.col("to_locked").alias("locked"))
    return whole.unionByName(cut).select(
        "job_id", "status", "attempts", F.col("progress").alias("progress_percent"),
        F.timestamp_millis("next_run").alias("next_run_at"), F.timestamp_millis("locked").alias("locked_at"))
