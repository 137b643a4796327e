"""Pipeline stages on tables with nulls, repeated ids, copies and extra columns whose names clash."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
WORDS = [f"q{i}" for i in range(600)]
CLASHING = ("score", "held_out", "component", "k_rows", "text_hash", "n_removed", "kept", "block", "row", "best")


def prose(seed, n=120):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_rows():
    a, b, c = prose(1), prose(2), prose(3)
    texts = [(9001, a), (9002, b), (9002, c), (9003, b), (9004, prose(4)), (9004, prose(4)), (None, prose(5)), (None, None), (9005, None), (9006, ""),
             (9007, " \t"), (9008, "one"), (9009, "one"), (9010, " ".join([prose(6, 300)] * 100))]
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts]


def counted(frame):
    found = frame.where("doc_id > 9000 OR doc_id IS NULL").collect()
    assert all(r.score == r.k_rows == r.n_removed == "clash" for r in found)
    return Counter((r.doc_id, r.text) for r in found)


def test_stages_decide_by_row(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame(odd_rows(), real.schema)
    docs = real.unionByName(odd).withColumns({c: F.lit("clash") for c in CLASHING})
    want = Counter((i, t) for i, t, *_ in odd_rows())
    (_, toxic), (_, near), (_, repeats), (_, leaks), (_, packing) = corpus_pipeline.STAGES
    after = toxic(spark, docs, SF)
    assert after.columns == docs.columns and counted(after) == want
    after = near(spark, after, SF)
    want -= Counter({(9003, prose(2)): 1, (9004, prose(4)): 1, (9009, "one"): 1})
    assert after.columns == docs.columns and counted(after) == want
    for stage in (repeats, leaks):
        after = stage(spark, after, SF)
        assert after.columns == docs.columns and counted(after) == want
    pieces = packing(spark, after, SF).where("doc_id > 9000 OR doc_id IS NULL").groupBy("doc_id", "piece").count().collect()
    assert sum(r["count"] for r in pieces if r.piece == 0) == sum(want.values())
    assert sum(1 for r in pieces if r.doc_id == 9010) > 1


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
