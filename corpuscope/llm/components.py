"""Connected components of an undirected graph, by label propagation and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import cut_lineage, free_unused


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` for every end of ``edges`` (``a long, b long``); the label is the smallest id reachable.

    Each round takes the smallest label among a node's neighbours and then follows the label's
    own label, so chains shorten by more than half. A round is checkpointed; the driver sees one count a round. Hot
    nodes only meet partial minima and a join that adaptive execution may split.
    """
    both = cut_lineage(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        moved = cut_lineage(step.join(jump, "label", "left").select(
            "id", F.least("label", F.coalesce("up", "label")).alias("label"),
            (F.least("label", F.coalesce("up", "label")) < F.col("old")).alias("moved")))
        labels = moved.select("id", "label")
        del near, step, jump
        free_unused(edges.sparkSession)
        if not moved.where("moved").limit(1).count():
            return labels
