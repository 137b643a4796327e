"""Prefix sums that survive a hot key.

A running sum over one key is one task.  Here a key's rows are cut into
buckets of its integer order; each bucket is a window of its own, and only one
row per bucket takes part in the window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_ROWS = 4096


def running_before(df: DataFrame, key: str, order: str, value: str,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``sum_before`` (values before the row) and ``peak_before`` (highest
    running total reached before the row, at least 0)."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / bucket_rows))
    local = W.partitionBy(key, "_bucket").orderBy(order)
    before = local.rowsBetween(W.unboundedPreceding, -1)
    inside = (
        cut.withColumn("_upto", F.sum(value).over(local.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
        .withColumn("_peak", F.max("_upto").over(before))
    )
    totals = cut.groupBy(key, "_bucket").agg(F.sum(value).alias("_total"))
    # the highest running total inside each bucket, relative to its start
    peaks = inside.groupBy(key, "_bucket").agg(F.max("_upto").alias("_top"))
    buckets = totals.join(peaks, [key, "_bucket"])
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))) \
        .withColumn("_crest", F.coalesce(F.max(F.col("_offset") + F.col("_top")).over(earlier), F.lit(0)))
    joined = inside.join(buckets.select(key, "_bucket", "_offset", "_crest"), [key, "_bucket"])
    return joined.select(
        *df.columns,
        (F.col("_offset") + F.col("_local")).alias("sum_before"),
        F.greatest(F.lit(0), F.col("_crest"), F.col("_offset") + F.col("_peak")).alias("peak_before"))
