"""Positions of rows inside their key, for keys of any size.

A window over a key sorts all of its rows in one task. Here the rows are range-partitioned
by key and order, so a hot key spans as many tasks as it has rows for; a position is a row's
place in its partition plus the rows of its key in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.session import dealt

_ROW_BITS = 33  # of monotonically_increasing_id


def with_positions(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "position", total: str | None = None) -> DataFrame:
    """``df`` with the 1-based place ``name`` of each row in its key, in the given order.

    ``keys`` are column names (null is a key of its own); ``order`` must end in something that
    tells rows of a hot key apart, since rows that tie stay together. ``total`` names a column
    for the number of rows of the key. The rows are written once below the checkpoint folder, sorted and so compact, in buckets by
    their partition, where they are numbered without moving again. Only keys that cross an edge between partitions, two rows an edge
    at most, are sent to all tasks with their counts.
    """
    at, spark = [F.col(k) for k in keys], df.sparkSession
    ids = df.repartitionByRange(*at, *order).sortWithinPartitions(*at, *order).withColumn("_at", F.monotonically_increasing_id())
    places = dealt(ids.withColumn("_pid", F.shiftrightunsigned("_at", _ROW_BITS)), "_pid", int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [f"_k{i}" for i in range(len(keys))]
    met = places.groupBy("_pid", *(F.col(k).alias(o) for k, o in zip(keys, own))).agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(*own)
    before = F.sum("_n").over(by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    cut = met.select(F.col("_pid").alias("_part"), *own, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by_key).alias("_total"),
                     F.count("*").over(by_key).alias("_parts")).where("_parts > 1").drop("_parts")
    on = F.col("_pid") == F.col("_part")
    for k, o in zip(keys, own):
        on = on & F.col(k).eqNullSafe(F.col(o))
    here = Window.partitionBy("_pid", *at)
    numbered = places.withColumn("_place", F.row_number().over(here.orderBy("_at")))
    if total:
        numbered = numbered.withColumn("_here", F.count("*").over(here))
    joined = numbered.join(F.broadcast(cut), on, "left")
    extra = [F.coalesce("_total", "_here").alias(total)] if total else []
    kept = [c for c in df.columns if c not in (name, total)]
    return joined.select(*kept, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(name), *extra)
