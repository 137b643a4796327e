"""Registered queries ``opN_<name>`` over the driver tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import brown, decontaminate, extract, hnsw, licenses, manifest, packing, substrings, suffixes, superminhash, toxicity, urls, whitening
from corpuscope.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_decontaminate(table) -> DataFrame:
    return decontaminate.find_leaks(table("documents"), table("benchmark"))


@register
def op2_substrings(table) -> DataFrame:
    cut = substrings.dedup_substrings(table("documents").select("doc_id", "text"), with_text=False)
    return cut.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


@register
def op3_toxicity(table) -> DataFrame:
    scored = toxicity.score_toxicity(table("documents").select("doc_id", "text"), table("labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op4_urls(table) -> DataFrame:
    judged = urls.judge_urls(table("pages"), urls.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op4_urls"] = urls.ORACLE


@register
def op5_packing(table) -> DataFrame:
    return packing.pack_documents(table("documents"), tokenizer_path())


@register
def op9_suffixes(table) -> DataFrame:
    cut = suffixes.dedup_suffixes(table("documents").select("doc_id", "text"), keep_first=False, with_text=False)
    return cut.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


@register
def op10_superminhash(table) -> DataFrame:
    return superminhash.group_duplicates(table("documents"), percent=85)


@register
def op8_brown(table) -> DataFrame:
    return brown.score_texts(table("documents"))


@register
def op7_hnsw(table) -> DataFrame:
    return hnsw.link_vectors(table("embeddings"))


@register
def op6_licenses(table) -> DataFrame:
    return licenses.scan_licenses(table("documents"))


@register
def op11_extract(table) -> DataFrame:
    return extract.extract_pages(table("pages")).select("page_id", "url", "text", "n_chars")


@register
def op12_manifest(table) -> DataFrame:
    return manifest.prove_rows(table("documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op12_manifest"] = manifest.oracle()


@register
def op13_whitening(table) -> DataFrame:
    return whitening.whiten_vectors(table("embeddings"))
