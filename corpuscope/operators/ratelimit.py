"""STR-1: anchored fixed-window request limiter, batch form.

A window starts with the first request of a key and ends a fixed time later;
the next request starts the next window.  Where a window starts depends on the
window before it, all the way back -- and one key may hold much of the log.

The log is range-partitioned by (key, time), so a busy key spans many
partitions.  Only keys cut by a partition edge need anything from elsewhere:

1. each partition describes such a run by a small step function, from the
   window start it might inherit to the window start it hands on;
2. the step functions of a key are chained (one row per partition and step);
3. each partition replays its rows, knowing what it inherits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope import params as P
from corpuscope.functions.text import millis
from corpuscope.session import cut_lineage

_STEP_SCHEMA = "key string, seg int, first_ms long, last_ms long, n long, upto_ms long, anchor_ms long, since long"
_ENTRY_SCHEMA = "key string, seg int, anchor_ms long, used long"


def _runs(keys: np.ndarray):
    """(key, from, to) of equal neighbours."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    bounds = np.concatenate([[0], edges, [len(keys)]])
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield keys[a], a, b


def _steps(times: np.ndarray, window: int):
    """Hand-over of one run: rows (upto_ms, anchor_ms, since).

    An inherited window ending at or before ``upto_ms`` (and after the row
    before) hands on ``anchor_ms`` with ``since`` requests in it.  A null
    anchor means the inherited window covers the whole run.
    """
    n = len(times)
    following = np.searchsorted(times, times + window, side="left")
    last = np.arange(n)
    for i in range(n - 1, -1, -1):  # last window start reached from i
        if following[i] < n:
            last[i] = last[following[i]]
    # an inherited window ends within one window length after the first row
    reach = int(np.searchsorted(times, times[0] + window, side="left"))
    out = []
    # equal times share their first position
    for i in np.unique(times[:reach + 1], return_index=True)[1].tolist():
        anchor = int(last[i])
        row = (int(times[i]), int(times[anchor]), int(n - anchor))
        if out and out[-1][1] == row[1]:
            out[-1] = row  # neighbouring starts meet in the same window
        else:
            out.append(row)
    return out


def _describe(window: int):
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # only the first and the last key of a partition can cross its edges,
        # and their times are 8 bytes each
        first: tuple | None = None
        current: tuple | None = None
        for batch in batches:
            if batch.empty:
                continue
            seg = int(batch["seg"].iloc[0])
            times = batch["ms"].to_numpy()
            for key, a, b in _runs(batch["key"].to_numpy()):
                if current is not None and current[0] == key:
                    current[2].append(times[a:b])
                    continue
                if current is not None and first is None:
                    first = current
                current = (key, seg, [times[a:b]])
        rows = []
        for run in (first, current):
            if run is None:
                continue
            key, seg, parts = run
            ms = np.concatenate(parts)
            for upto, anchor, since in _steps(ms, window):
                rows.append((key, seg, int(ms[0]), int(ms[-1]), len(ms), upto, anchor, since))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STEP_SCHEMA.split(", ")])

    return describe


def _chain(window: int):
    def chain(steps: pd.DataFrame) -> pd.DataFrame:
        """Entries of one key: what each of its partitions inherits."""
        rows, anchor, used = [], None, 0
        for seg, part in steps.sort_values(["seg", "upto_ms"]).groupby("seg", sort=True):
            rows.append((part["key"].iloc[0], int(seg), anchor, used))
            first = part.iloc[0]
            if anchor is None:
                step = first  # the first request opens a window
            else:
                end = anchor + window
                if end > first["last_ms"]:
                    used += int(first["n"])  # the whole run lies in the inherited window
                    continue
                step = part[part["upto_ms"] >= end].iloc[0]
            anchor, used = int(step["anchor_ms"]), int(step["since"])
        out = pd.DataFrame(rows, columns=["key", "seg", "anchor_ms", "used"])
        return out.astype({"anchor_ms": "Int64"})

    return chain


def _replay(window: int):
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, anchor, used = None, None, 0
        for batch in batches:
            times = batch["ms"].to_numpy()
            starts = np.empty(len(batch), dtype=np.int64)
            counts = np.empty(len(batch), dtype=np.int64)
            inherited = batch["entry_anchor"].to_numpy(dtype="float64", na_value=np.nan)
            entry_used = batch["entry_used"].fillna(0).to_numpy(dtype="int64")
            for key, a, b in _runs(batch["key"].to_numpy()):
                if key != key_now:
                    key_now = key
                    anchor = None if np.isnan(inherited[a]) else int(inherited[a])
                    used = int(entry_used[a]) if anchor is not None else 0
                i = a
                while i < b:
                    if anchor is None or times[i] - anchor >= window:
                        anchor, used = int(times[i]), 0
                    stop = a + int(np.searchsorted(times[a:b], anchor + window, side="left"))
                    starts[i:stop] = anchor
                    counts[i:stop] = used + np.arange(1, stop - i + 1)
                    used += stop - i
                    i = stop
            yield batch.assign(window_start_ms=starts, request_no=counts).drop(
                columns=["entry_anchor", "entry_used"])

    return replay


def rate_limit(requests: DataFrame, limits: dict[str, int] | None = None,
               window_ms: int = P.RATE_WINDOW_MS) -> DataFrame:
    """``requests(request_id, caller, bucket, ts)`` -> verdict per request.

    ``bucket`` null means unlimited and is allowed outright.  Every request
    counts, denied ones too.
    """
    limits = P.RATE_LIMITS if limits is None else limits
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    limited = requests.filter(F.col("bucket").isNotNull()).select(
        "request_id", F.concat_ws(":", F.col("caller").cast("string"), "bucket").alias("key"), "bucket",
        millis("ts").alias("ms"))
    laid_out = (
        limited.repartitionByRange("key", "ms", "request_id")
        .sortWithinPartitions("key", "ms", "request_id")
        .withColumn("seg", F.spark_partition_id())
    )
    # range bounds are sampled: the layout must be fixed before it is read twice
    laid_out = cut_lineage(laid_out)
    entries = (
        laid_out.select("key", "seg", "ms").mapInPandas(_describe(window_ms), _STEP_SCHEMA)
        .groupBy("key").applyInPandas(_chain(window_ms), _ENTRY_SCHEMA)
        .select("key", "seg", F.col("anchor_ms").alias("entry_anchor"), F.col("used").alias("entry_used"))
    )
    # at most two rows per partition of the log
    ready = laid_out.join(F.broadcast(entries), ["key", "seg"], "left").select(
        "request_id", "key", "bucket", "ms", "entry_anchor", "entry_used")
    schema = "request_id long, key string, bucket string, ms long, window_start_ms long, request_no long"
    judged = ready.mapInPandas(_replay(window_ms), schema)
    rest = F.lit(window_ms) - (F.col("ms") - F.col("window_start_ms"))
    allowed = F.col("request_no") <= F.try_element_at(table, F.col("bucket"))
    return judged.select(
        "request_id", "key", "bucket", "window_start_ms", "request_no", allowed.alias("allowed"),
        F.when(~allowed, F.greatest(F.lit(1), F.floor((rest + 999) / 1000))).alias("retry_after_s"))
