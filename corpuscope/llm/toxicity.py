"""Toxicity: logistic regression by FTRL-proximal over hashed n-grams and skip-grams.

Features are the presence of a lower-cased word, of a pair of neighbours and of
a pair with one word between, hashed into ``2 ** bits`` buckets. Each training
shard runs FTRL-proximal (per-coordinate rates, L1 and L2) over its rows; the
shards' weights are averaged by bucket. L1 leaves few weights other than zero:
at most ``2 ** bits`` pairs, 8 MiB, travel to the scoring tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm import arrays as A


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled sample that is fitted, ``shard_rows`` one shard of it."""

    bits: int = 19
    max_rows: int = 24_576
    shard_rows: int = 8_192
    passes: int = 5
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.5


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair and skip pair of the texts."""
    buffer, begin = A.join_texts(texts)
    start, stop = A.word_spans(buffer, A.NON_ALNUM)
    hashes = A.word_hashes(buffer, start, stop, fold=True)
    row = np.searchsorted(begin, start, side="right") - 1
    shift, out = np.uint64(64 - bits), [(row, hashes)]
    for gap in (1, 2):
        if len(hashes) > gap:
            same = row[gap:] == row[:-gap]
            pair = A.mix(hashes[:-gap] * np.uint64(2 * gap + 1) + hashes[gap:])
            out.append((row[gap:][same], pair[same]))
    return np.concatenate([r for r, _ in out]), (np.concatenate([h for _, h in out]) >> shift).astype(np.int64)


def fit_shard(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights after ``passes`` rounds of FTRL-proximal; index 0 of the extra last slot is the bias."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi, ni = z[at], n[at]
        w = (np.sign(zi) * s.l1 - zi) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)
        w[np.abs(zi) <= s.l1] = 0
        return w

    order = np.random.default_rng(7)
    for _ in range(s.passes):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[at] = ni + g * g
    return weights(np.arange(size))


def train(labelled: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) fitted on rows ``doc_id, text, label``.

    Above ``max_rows`` labelled rows, about that many are taken by the hash of doc_id. Null
    labels are left out; an empty table gives no weights, hence a score of one half.
    """
    s = settings
    labelled = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label")).where("label IS NOT NULL")
    total = labelled.select("doc_id").count()
    if not total:
        return np.zeros(0, np.int64), np.zeros(0)
    slot = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    sample = labelled.where(slot < int(min(1.0, s.max_rows / total) * (1 << 30)))
    shards = -(-min(total, s.max_rows) // s.shard_rows)
    sample = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        texts, labels = A.as_bytes(table["text"]), table["label"].to_numpy().astype(float)
        rows: list[np.ndarray] = []
        bias = np.array([1 << s.bits])
        for part in A.text_chunks(texts):
            row, bucket = features(texts[part], s.bits)
            key = np.unique(row << 32 | bucket)
            cuts = np.searchsorted(key, np.arange(1, part.stop - part.start) << 32)
            rows += [np.concatenate((k & 0xFFFFFFFF, bias)) for k in np.split(key, cuts)]
        w = fit_shard(rows, labels, s)
        at = np.flatnonzero(w)
        del rows
        A.release()
        return pa.table({"bucket": at, "w": w[at]})

    parts = sample.groupBy("shard").applyInArrow(fit, "bucket long, w double")
    rows = parts.groupBy("bucket").agg((F.sum("w") / shards).alias("w")).toPandas().sort_values("bucket")
    return rows["bucket"].to_numpy(), rows["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = Settings.bits) -> DataFrame:
    """Adds ``score`` (0 to 1) to the rows; null and empty texts get the bias alone."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            texts = A.as_bytes(batch["text"])
            out = np.full(len(texts), float(dense[-1]))
            for part in A.text_chunks(texts):
                row, bucket = features(texts[part], bits)
                hit = np.flatnonzero(dense[bucket])
                key = np.unique(row[hit] << 32 | bucket[hit])
                np.add.at(out, (key >> 32) + part.start, dense[key & 0xFFFFFFFF])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))],
                                             names=[*batch.schema.names, "score"])
        A.release()

    return docs.mapInArrow(run, schema)


def fold_of(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``held_out, score``; learns only from labelled rows that are not held out.

    ``docs`` needs ``doc_id`` and ``text``; all its columns stay. Labels join by doc_id
    (several labels of one id are all examples; null ids join nothing).
    """
    keyed = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("label"))
    examples = docs.select("doc_id", "text").where(fold_of(F.col("doc_id"), 4) != 2).join(keyed, "doc_id")
    model = train(examples, settings)
    rest = docs.drop("held_out", "score")
    return score(rest, model, settings.bits).withColumn("held_out", fold_of(F.col("doc_id"), 4) == 2)
