"""STR-1 as a stream: the anchored limiter with keyed state.

State per key is two numbers.  An event-time timer clears it once the watermark
passes the end of the window: any later request would start a new window
anyway, so idle callers cost nothing.  Within a micro-batch a key's requests
are taken in time order; a request behind the watermark, or without a time, changes no window and comes out as ``late``, without a verdict.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuscope import params as P
from corpuscope.functions.text import millis

# the processor travels with the query: the streaming runner on the driver does
# not see files added to the context
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = ("key string, request_id long, bucket string, window_start_ms long, request_no long, "
          "allowed boolean, retry_after_s long, late boolean")
_OUT = Row(*(c.split()[0] for c in OUTPUT.split(", ")))


class AnchoredWindow(StatefulProcessor):
    """One fixed window per key, started by its first request."""

    def __init__(self, limits: dict[str, int], window_ms: int):
        self.limits, self.window_ms = limits, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # most keys have a handful of requests a batch: plain rows, and as few calls to the state store as there can be
        watermark = timerValues.getCurrentWatermarkInMs()
        start, used = self.window.get() or (None, 0)
        before = start, used
        timely = []
        for r in rows:
            if r.ms is None or r.ms < watermark:
                yield _OUT(key[0], r.request_id, r.bucket, None, None, None, None, True)
            else:
                timely.append((r.ms, r.request_id, r.bucket))
        for ms, request_id, bucket in sorted(timely):
            if start is None or ms - start >= self.window_ms:
                start, used = ms, 0
            used += 1
            allowed = used <= self.limits[bucket]
            wait = None if allowed else max(1, (self.window_ms - (ms - start) + 999) // 1000)
            yield _OUT(key[0], request_id, bucket, start, used, allowed, wait, False)
        if (start, used) != before:
            self.window.update((start, used))
        if start != before[0]:  # one timer a window
            self.handle.registerTimer(start + self.window_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.window.get()
        if held is not None and held[0] + self.window_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(requests: DataFrame, limits: dict[str, int] | None = None,
                      window_ms: int = P.RATE_WINDOW_MS, delay: str = "10 minutes") -> DataFrame:
    """``requests(request_id, caller, bucket, ts)`` as a stream -> verdicts."""
    limits = P.RATE_LIMITS if limits is None else limits
    keyed = (
        requests.filter(F.col("bucket").isNotNull())
        .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        .select(F.concat_ws(":", F.col("caller").cast("string"), "bucket").alias("key"),
                "request_id", "bucket", millis("ts").alias("ms"), "ts")
    )
    return keyed.groupBy("key").transformWithState(
        AnchoredWindow(dict(limits), window_ms), OUTPUT, outputMode="Append", timeMode="EventTime")
