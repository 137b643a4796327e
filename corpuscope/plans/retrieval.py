"""Registered queries: vector search, hydration and retrieval evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import head_chars, split_lines
from corpuscope.functions.vectors import cosine
from corpuscope.operators import evaluation as E
from corpuscope.operators import retrieval as R
from corpuscope.plans.derived import text_files
from corpuscope.plans.registry import Tables, query
from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources import sinks

DIM = 64


def _queries(t: Tables) -> DataFrame:
    """Questions of the benchmark: the vectors whose id is a benchmark item."""
    return (
        t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
        .select(F.col("vec_id").alias("query_id"), "embedding", "label")
    )


def _chunks(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


SIM_SQL = "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9)"

TOPK_SQL = f"""
q AS MATERIALIZED (SELECT vec_id AS query_id, embedding, label FROM embeddings
      WHERE vec_id IN (SELECT item_id FROM benchmark)),
scored AS MATERIALIZED (
  SELECT q.query_id, c.vec_id AS chunk_id, {SIM_SQL} AS similarity,
         q.label AS query_label, c.label AS chunk_label
  FROM q JOIN embeddings c ON q.query_id <> c.vec_id),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM scored),
top10 AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= 10)
"""


def _top10(t: Tables) -> DataFrame:
    return R.vector_topk(_queries(t).select("query_id", "embedding"), _chunks(t).select("chunk_id", "embedding"),
                         10, exclude_self=True)


@query("vector_topk_batch", f"WITH {TOPK_SQL} SELECT query_id, chunk_id, rank, round(similarity, 5) AS similarity FROM top10")
def vector_topk_batch(t: Tables) -> DataFrame:
    return _top10(t).select("query_id", "chunk_id", "rank", F.round("similarity", 5).alias("similarity"))


@query("vector_topk_single", f"""
SELECT c.vec_id AS chunk_id, round({SIM_SQL}, 5) AS similarity
FROM embeddings c, (SELECT embedding, vec_id FROM embeddings ORDER BY vec_id LIMIT 1) q
WHERE c.vec_id <> q.vec_id ORDER BY {SIM_SQL} DESC, c.vec_id LIMIT 10""")
def vector_topk_single(t: Tables) -> DataFrame:
    first = t.embeddings.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("query_id"), "embedding")
    found = R.vector_topk(first, _chunks(t).select("chunk_id", "embedding"), 10,
                          exclude_self=True)
    return found.select("chunk_id", F.round("similarity", 5).alias("similarity"))


@query("vector_topk_scoped", f"""
WITH {TOPK_SQL}, scoped AS (
  SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM scored WHERE query_label = chunk_label)
SELECT query_id, chunk_id, rank, round(similarity, 5) AS similarity FROM scoped WHERE rank <= 5""")
def vector_topk_scoped(t: Tables) -> DataFrame:
    """Project isolation (FLT-7): a query only sees chunks of its own project."""
    found = R.vector_topk(
        _queries(t).select("query_id", "embedding", F.col("label").alias("scope")),
        _chunks(t).select("chunk_id", "embedding", F.col("label").alias("scope")),
        5, exclude_self=True)
    return found.select("query_id", "chunk_id", "rank", F.round("similarity", 5).alias("similarity"))


def _approximate(t: Tables) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(t.spark)}/cells-{uuid.uuid4().hex}"
    queries = _queries(t).select("query_id", "embedding")
    R.build_cells(_chunks(t), folder)
    R.audit_cells(queries, folder, 10, exclude_self=True)
    return R.approximate_topk(queries, folder, 10, exclude_self=True)


@query("vector_topk_approximate")
def vector_topk_approximate(t: Tables) -> DataFrame:
    """RET-3 over cells learned from the vectors."""
    return _approximate(t).select("query_id", "chunk_id", "rank", "similarity")


@query("vector_recall", f"""WITH {TOPK_SQL} SELECT query_id, count(*) AS n_found, true AS nine_of_ten FROM top10 GROUP BY query_id""")
def vector_recall(t: Tables) -> DataFrame:
    """RET-3: whether each query finds nine tenths of its exact top ten, as the audit promises."""
    exact = _top10(t).select("query_id", "chunk_id")
    found = _approximate(t).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n_found"))
    hits = exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        (F.count("hit") >= 0.9 * F.count("*")).alias("nine_of_ten"))
    return counts.join(hits, "query_id")


@query("cosine_similarity", """
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS similarity
FROM embeddings""")
def cosine_similarity(t: Tables) -> DataFrame:
    """FN-9 as an expression: each vector against its own reversal."""
    return t.embeddings.select(
        "vec_id", F.round(cosine("embedding", F.reverse("embedding")), 5).alias("similarity"))


def _judged(t: Tables) -> DataFrame:
    """Relevance is label equality; counted per label, never paired up."""
    queries, chunks = _queries(t), _chunks(t)
    sizes = chunks.groupBy("label").agg(F.count("*").alias("n"))
    wanted = queries.join(sizes, "label").select(
        "query_id", F.col("label").alias("query_label"), (F.col("n") - 1).alias("n_relevant"))
    ranked = _top10(t).join(chunks.select("chunk_id", "label"), "chunk_id").select("query_id", "rank", "label")
    return wanted.join(ranked, "query_id", "left").select(
        "query_id", "n_relevant", "rank",
        F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)).alias("hit"))


METRIC_SQL = TOPK_SQL + """,
sizes AS (SELECT label, count(*) - 1 AS n_relevant FROM embeddings GROUP BY label),
judged AS (
  SELECT q.query_id, s.n_relevant, r.rank, coalesce(r.query_label = r.chunk_label, false) AS hit
  FROM q JOIN sizes s USING (label) LEFT JOIN top10 r USING (query_id)),
metrics AS MATERIALIZED (
  SELECT query_id,
    count(*) FILTER (hit AND rank <= 5) / 5.0::DOUBLE AS precision_at_5,
    count(*) FILTER (hit AND rank <= 10) / 10.0::DOUBLE AS precision_at_10,
    coalesce(count(*) FILTER (hit AND rank <= 5) / nullif(max(n_relevant), 0)::DOUBLE, 0) AS recall_at_5,
    coalesce(count(*) FILTER (hit AND rank <= 10) / nullif(max(n_relevant), 0)::DOUBLE, 0) AS recall_at_10,
    CASE WHEN count(*) FILTER (hit AND rank <= 5) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_at_5,
    CASE WHEN count(*) FILTER (hit AND rank <= 10) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_at_10,
    coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS mrr
  FROM judged GROUP BY query_id)
"""


def _rounded() -> list:
    return [F.round(n, 6).alias(n) for n in E.metric_names()]


ROUNDED_SQL = ", ".join(f"round({n}, 6) AS {n}" for n in E.metric_names())
MEAN_SQL = ", ".join(f"round(avg({n}), 6) AS {n}" for n in E.metric_names())


@query("query_metrics", f"WITH {METRIC_SQL} SELECT query_id, {ROUNDED_SQL} FROM metrics")
def query_metrics(t: Tables) -> DataFrame:
    return E.query_metrics(_judged(t)).select("query_id", *_rounded())


@query("eval_results", f"""WITH {METRIC_SQL}, one AS (SELECT {MEAN_SQL} FROM metrics)
SELECT query_id, {ROUNDED_SQL}, (SELECT mrr FROM one) AS mean_mrr FROM metrics""")
def eval_results(t: Tables) -> DataFrame:
    """SRC-10: aggregate and per-question results, written as JSON and read back."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/eval-{uuid.uuid4().hex}"
    per_question = query_metrics(t)
    aggregate = _aggregate(t).select(*_rounded())
    sinks.write_results(aggregate, per_question, folder)
    mean = t.spark.read.schema(aggregate.schema).json(f"{folder}/eval_aggregate").select(F.col("mrr").alias("mean_mrr"))
    return t.spark.read.schema(per_question.schema).json(f"{folder}/eval_results").join(F.broadcast(mean))


def _aggregate(t: Tables) -> DataFrame:
    metrics = E.query_metrics(_judged(t)).withColumn("error", F.lit(None).cast("string"))
    return E.macro_average(metrics)


@query("retrieval_eval", f"""
WITH {METRIC_SQL} SELECT {MEAN_SQL}, count(*) AS total_questions, 0::BIGINT AS failed_questions FROM metrics""")
def retrieval_eval(t: Tables) -> DataFrame:
    """Flagship: top-k search, relevance, per-query metrics, macro means."""
    return _aggregate(t).select(*_rounded(), "total_questions", "failed_questions")


THRESHOLDS = {"precision_at_5": 0.5, "recall_at_5": 0.0, "mrr": 0.9, "hit_rate_at_5": 0.2, "_note": 9.0}


@query("eval_gate", f"""
WITH {METRIC_SQL}, a AS (SELECT avg(precision_at_5) AS p, avg(recall_at_5) AS r, avg(mrr) AS m, avg(hit_rate_at_5) AS h FROM metrics),
v AS (SELECT 'precision_at_5' AS metric, p AS value, 0.5 AS threshold FROM a UNION ALL SELECT 'recall_at_5', r, 0.0 FROM a
      UNION ALL SELECT 'mrr', m, 0.9 FROM a UNION ALL SELECT 'hit_rate_at_5', h, 0.2 FROM a)
SELECT metric, round(value, 6) AS value, threshold::DOUBLE AS threshold FROM v WHERE value + 1e-9 < threshold""")
def eval_gate(t: Tables) -> DataFrame:
    return E.gate_breaches(_aggregate(t), THRESHOLDS).select(
        "metric", F.round("value", 6).alias("value"), "threshold")


@query("retrieval_failures", f"WITH {METRIC_SQL} SELECT query_id, round(recall_at_5, 6) AS recall_at_5 FROM metrics WHERE recall_at_5 < 1")
def retrieval_failures(t: Tables) -> DataFrame:
    metrics = E.query_metrics(_judged(t)).withColumn("error", F.lit(None).cast("string"))
    return E.retrieval_failures(metrics).select("query_id", F.round("recall_at_5", 6).alias("recall_at_5"))


# ---- hydration: chunk i is the text of document i --------------------------

def _text_chunks(t: Tables) -> DataFrame:
    files = text_files(t.documents).select("file_id", "content", "path")
    return files.select(
        F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long").alias("chunk_id"), "file_id",
        "content", F.lit(1).alias("start_line"), F.size(split_lines("content")).alias("end_line"))


def _known_files(t: Tables) -> DataFrame:
    """Files that still exist: the labelled documents."""
    return text_files(t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi"))


LINES_SQL = "(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))))::INT"

HYDRATE_SQL = TOPK_SQL + """,
known AS MATERIALIZED (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
texts AS (SELECT doc_id, text FROM documents)
"""


@query("search_hydrate_inner", f"""
WITH {HYDRATE_SQL}
SELECT query_id, rank, chunk_id, path AS file_path, substr(text, 1, 200) AS preview, round(similarity, 5) AS similarity
FROM top10 JOIN texts ON chunk_id = texts.doc_id JOIN known ON chunk_id = known.doc_id""")
def search_hydrate_inner(t: Tables) -> DataFrame:
    return R.hydrate_results(_top10(t), _text_chunks(t), _known_files(t)).select(
        "query_id", "rank", "chunk_id", "file_path", "preview", F.round("similarity", 5).alias("similarity"))


@query("context_hydrate_outer", f"""
WITH {HYDRATE_SQL}
SELECT query_id, rank, chunk_id, coalesce(path, 'unknown') AS file_path, 1 AS start_line,
       {LINES_SQL} AS end_line, substr(text, 1, 2000) AS content
FROM top10 JOIN texts ON chunk_id = texts.doc_id LEFT JOIN known ON chunk_id = known.doc_id WHERE rank <= 5""")
def context_hydrate_outer(t: Tables) -> DataFrame:
    return R.hydrate_context(_top10(t).filter("rank <= 5"), _text_chunks(t), _known_files(t))


@query("context_assembly", f"""
WITH {HYDRATE_SQL}
SELECT query_id, md5(string_agg('File: ' || coalesce(path, 'unknown') || chr(10) || 'Lines: 1-' || {LINES_SQL}
    || chr(10) || 'Code:' || chr(10) || substr(text, 1, 2000), chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM top10 JOIN texts ON chunk_id = texts.doc_id LEFT JOIN known ON chunk_id = known.doc_id
WHERE rank <= 5 GROUP BY query_id""")
def context_assembly(t: Tables) -> DataFrame:
    context = R.hydrate_context(_top10(t).filter("rank <= 5"), _text_chunks(t), _known_files(t))
    return R.assemble_context(context).select("query_id", F.md5("context").alias("context_md5"))


@query("citations_json_roundtrip", f"""
WITH {HYDRATE_SQL}
SELECT query_id, count(*) AS n_citations, min(coalesce(path, 'unknown')) AS first_path
FROM top10 JOIN texts ON chunk_id = texts.doc_id LEFT JOIN known ON chunk_id = known.doc_id
WHERE rank <= 5 GROUP BY query_id""")
def citations_json_roundtrip(t: Tables) -> DataFrame:
    """FN-19: written as JSON text, read back with ``from_json``."""
    context = R.hydrate_context(_top10(t).filter("rank <= 5"), _text_chunks(t), _known_files(t))
    back = F.from_json("citations", "array<struct<rank:int,file_path:string,start_line:int,end_line:int,content:string>>")
    return R.citations_json(context).withColumn("back", back).select(
        "query_id", F.size("back").cast("long").alias("n_citations"),
        F.array_min(F.transform("back", lambda c: c["file_path"])).alias("first_path"))


@query("ranked_distinct_files", f"""
WITH {TOPK_SQL}, f AS (SELECT query_id, source AS path, min(rank) AS first_rank
  FROM top10 JOIN documents ON chunk_id = doc_id GROUP BY ALL)
SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS rank FROM f""")
def ranked_distinct_files(t: Tables) -> DataFrame:
    paths = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"))
    return R.ranked_files(_top10(t), paths)


@query("message_assembly", """
WITH first_turn AS (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
prompts AS (SELECT c.conv_id, c.text AS content, c.turn AS at FROM conversations c JOIN first_turn f
            ON c.conv_id = f.conv_id AND c.turn = f.last_turn)
SELECT conv_id, (-1)::BIGINT AS seq, 'system' AS role, 'Answer from the code.' AS content FROM prompts
UNION ALL SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN prompts p ON c.conv_id = p.conv_id
  WHERE c.turn < p.at AND c.role IN ('user', 'assistant') AND c.text <> ''
UNION ALL SELECT conv_id, 4611686018427387904, 'user', content FROM prompts""")
def message_assembly(t: Tables) -> DataFrame:
    asked = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("content"), F.max("turn").alias("at"))
    history = t.conversations.join(asked.select("conv_id", "at"), "conv_id").filter("turn < at").select(
        "conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return R.assemble_messages(history, asked.select("conv_id", "content"), "Answer from the code.")


@query("snippet_lengths", """
SELECT doc_id, substr(text, 1, 200) AS preview, length(substr(text, 1, 2000))::INT AS context_chars,
       length(substr(text, 1, 400))::INT AS line_chars FROM documents""")
def snippet_lengths(t: Tables) -> DataFrame:
    """FN-10."""
    return t.documents.select(
        "doc_id", head_chars("text", 200).alias("preview"),
        F.length(head_chars("text", 2000)).alias("context_chars"),
        F.length(head_chars("text", 400)).alias("line_chars"))
