"""Training-corpus pipeline over ``documents``: five filters and a packing, one after another.

Each stage's rows are written as Parquet to the shared checkpoint folder and reread
as the next one's input, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import decontaminate, packing, substrings, superminhash, toxicity
from corpuscope.llm.queries import tokenizer_path
from corpuscope.session import ensure_checkpoint_dir, ship_package

TOXIC_AT = 0.3


def _aside(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns as one, so that none can clash with what an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("_rest"))


def _back(frame: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    return frame.select(*(changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c]).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    ship_package(spark)
    scored = toxicity.score_toxicity(_aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(scored.where(F.col("score") < TOXIC_AT), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id; rows without words stay."""
    ship_package(spark)
    return superminhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; n_chars follows.

    A document keeps its text as it is if nothing is cut; one left without words goes.
    """
    ship_package(spark)
    cut = substrings.dedup_substrings(_aside(docs))
    hit = F.col("n_removed") > 0
    left = cut.where(~hit | (F.col("n_removed") < F.col("n_units")))
    text = F.when(hit, F.col("kept").cast("string")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.char_length(text).cast("long")).otherwise(F.col("_rest")["n_chars"])
    return _back(left, docs, **changed)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their training sequence and place in it."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: no stage but the first filter could be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; the last stage's rows."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
