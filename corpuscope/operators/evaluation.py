"""Retrieval metrics, gates and run reports (AGG-1 .. AGG-16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscope import params as P
from corpuscope.session import cut_lineage


def judged(queries: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Left join of ranked rows to relevance, one row per retrieved item.

    ``queries(query_id, n_relevant)``, ``ranked(query_id, item, rank)``,
    ``relevant(query_id, item)``.  Queries without results keep one empty row.
    """
    hits = ranked.join(relevant.select("query_id", "item").distinct()
                       .withColumn("hit", F.lit(True)), ["query_id", "item"], "left")
    return queries.join(
        hits.select("query_id", "rank", F.coalesce("hit", F.lit(False)).alias("hit")), "query_id", "left")


def _hits(k: int) -> Column:
    return F.count_if(F.col("hit") & (F.col("rank") <= k))


def precision_at(k: int) -> Column:
    """AGG-1: divided by k even when fewer rows came back."""
    return (_hits(k) / F.lit(k)).alias(f"precision_at_{k}")


def recall_at(k: int) -> Column:
    """AGG-2: 0 when nothing is relevant."""
    n = F.max("n_relevant")
    return F.when(n > 0, _hits(k) / n).otherwise(0.0).alias(f"recall_at_{k}")


def reciprocal_rank() -> Column:
    """AGG-3: over the whole list."""
    return F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("mrr")


def hit_rate_at(k: int) -> Column:
    """AGG-4."""
    return F.when(_hits(k) > 0, 1.0).otherwise(0.0).alias(f"hit_rate_at_{k}")


def metric_columns(ks=P.EVAL_KS) -> list[Column]:
    return [m(k) for m in (precision_at, recall_at, hit_rate_at) for k in ks] + [reciprocal_rank()]


def metric_names(ks=P.EVAL_KS) -> list[str]:
    return [f"{m}_at_{k}" for m in ("precision", "recall", "hit_rate") for k in ks] + ["mrr"]


def query_metrics(judged_rows: DataFrame, ks=P.EVAL_KS) -> DataFrame:
    """AGG-5: every metric of every query in one aggregation."""
    return judged_rows.groupBy("query_id").agg(*metric_columns(ks))


def macro_average(metrics: DataFrame, ks=P.EVAL_KS) -> DataFrame:
    """AGG-6: means over the successful queries; ``error`` marks a failure."""
    ok = F.col("error").isNull()
    return metrics.agg(
        *[F.coalesce(F.avg(F.when(ok, F.col(n))), F.lit(0.0)).alias(n) for n in metric_names(ks)],
        F.count("*").alias("total_questions"), F.count("error").alias("failed_questions"))


def gate_breaches(aggregate: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """AGG-7: one row per breached threshold; keys with ``_`` are notes."""
    known = [k for k in thresholds if not k.startswith("_") and k in aggregate.columns]
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"),
                               F.lit(float(thresholds[k])).alias("threshold")) for k in known])
    failed = F.struct(F.lit("failed_questions").alias("metric"),
                      F.col("failed_questions").cast("double").alias("value"), F.lit(0.0).alias("threshold"))
    row = aggregate.select(F.inline(F.concat(cells, F.array(failed))))
    low = F.col("value") + P.GATE_EPSILON < F.col("threshold")
    return row.filter(F.when(F.col("metric") == "failed_questions", F.col("value") > 0).otherwise(low))


def verdict_ratio(verdicts="verdicts", points="reference_points") -> list[Column]:
    """AGG-8: passed / points; lists of different length score 0 with a flag."""
    mismatch = F.size(verdicts) != F.size(points)
    passed = F.when(mismatch, 0).otherwise(F.size(F.filter(verdicts, lambda v: v)))
    ratio = F.when(mismatch | (F.size(points) == 0), 0.0).otherwise(passed / F.size(points))
    return [passed.alias("points_passed"), F.size(points).alias("points_total"),
            ratio.alias("points_ratio"), mismatch.alias("length_mismatch")]


def run_aggregates(runs: DataFrame) -> DataFrame:
    """AGG-9: one global row; failed runs count but do not enter the means.

    p95 is a distributed order statistic (:func:`nearest_ranks`).
    """
    ok = F.col("error").isNull()

    def mean(name):
        return F.coalesce(F.avg(F.when(ok, F.col(name))), F.lit(0.0))

    def total(name):
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0))

    totals = runs.agg(
        mean("citation_accuracy").alias("citation_accuracy"),
        mean("points_ratio").alias("answer_accuracy"),
        F.coalesce(F.avg(F.when(ok, (F.col("points_ratio") == 1.0).cast("double"))), F.lit(0.0))
        .alias("all_points_pass_rate"),
        mean("latency_s").alias("avg_latency_s"),
        mean("tool_calls").alias("avg_tool_calls"),
        mean("iterations").alias("avg_iterations"),
        mean("cost_usd").alias("avg_cost_usd"),
        total("cost_usd").alias("total_cost_usd"),
        total("input_tokens").alias("input_tokens_total"),
        total("output_tokens").alias("output_tokens_total"),
        F.count("*").alias("total_runs"),
        F.count_if(~ok).alias("failed_runs"),
        F.count("judge_error").alias("judge_errors"),
    )
    p95 = nearest_ranks(runs.filter(ok).withColumn("all", F.lit(0)), "latency_s", 0.95, ["all"]).select(
        F.col("value").alias("p95_latency_s"))
    # both sides are aggregates of one row at most
    return totals.join(F.broadcast(p95), how="left").withColumn("p95_latency_s", F.coalesce("p95_latency_s", F.lit(0.0)))


def same_keys(left: list[str], right: list[str]) -> Column:
    """Equality of two lists of columns, null equal to null."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)))


def nearest_ranks(df: DataFrame, column: str, fraction: float, keys: list[str]) -> DataFrame:
    """AGG-10: per key the ``value`` at place ``ceil(fraction * n)`` of its values in order; 0.0 for a key without any.

    Values are counted first, then range-partitioned by key and value, so a key of any size spans many tasks. One
    weight for each key and partition tells which partition holds the rank; only that slice of the key is ordered.
    """
    counted = df.groupBy(*keys, F.col(column).cast("double").alias("value")).agg(F.count(column).alias("n"))
    placed = cut_lineage(counted.where("n > 0").repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()))
    own = [f"_{k}" for k in keys]
    slices = placed.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col("_part").alias("_slice")).agg(F.sum("n").alias("_weight"))
    by_key = W.partitionBy(*own)  # a row for each partition that the key meets
    millionths = round(fraction * 1_000_000)
    before = F.coalesce(F.sum("_weight").over(by_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    target = F.floor((F.sum("_weight").over(by_key) * millionths + 999_999) / F.lit(1_000_000).cast("decimal(10,0)"))
    holding = slices.select(*own, "_slice", "_weight", before.alias("_before"), target.alias("_target")).where(
        "_before < _target AND _before + _weight >= _target")
    inside = placed.join(holding, same_keys(keys, own) & (F.col("_part") == F.col("_slice"))).drop(*keys)
    upto = F.col("_before") + F.sum("n").over(W.partitionBy(*own).orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).where("_upto >= _target").groupBy(*own).agg(F.min("value").alias("value"))
    return df.select(*keys).distinct().join(found, same_keys(keys, own), "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))


def retrieval_failures(metrics: DataFrame) -> DataFrame:
    """AGG-11 for searches: an error, or recall@5 below 1."""
    return metrics.filter(F.col("error").isNotNull() | (F.coalesce("recall_at_5", F.lit(1.0)) < 1.0))


def run_failures(runs: DataFrame) -> DataFrame:
    """AGG-11 for runs."""
    return runs.filter(
        F.col("error").isNotNull() | F.col("judge_error").isNotNull()
        | (F.col("citation_accuracy") < 1.0) | (F.col("points_ratio") < 1.0))


def token_usage(calls: DataFrame) -> DataFrame:
    """AGG-15: tokens per run; a missing total is the sum of both sides."""
    total = F.sum("total_tokens")
    parts = F.coalesce(F.sum("input_tokens"), F.lit(0)) + F.coalesce(F.sum("output_tokens"), F.lit(0))
    return calls.groupBy("run_id").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.nullif(total, F.lit(0)), parts).alias("total_tokens"))


def tool_call_key() -> Column:
    """AGG-16: what makes two calls of a run the same work (null: never)."""
    return (
        F.when(F.col("tool") == "search_code", F.col("query"))
        .when(F.col("tool") == "read_file", F.col("file_path"))
        .when(F.col("tool") == "grep", F.concat_ws(":", F.lit("grep"), "pattern", "file_path"))
    )


def mark_repeats(calls: DataFrame) -> DataFrame:
    """AGG-16: ``is_repeat`` per call.

    The first call of a key comes from a ``min`` aggregate (combined before
    the shuffle) joined back, so one busy run or key is never one window.
    """
    # search texts and grep keys share one set of seen searches
    bucket = F.when(F.col("tool") == "read_file", "file").otherwise("search")
    keyed = calls.withColumn("key", tool_call_key()).withColumn("bucket", bucket)
    first = keyed.filter("key IS NOT NULL").groupBy("run_id", "bucket", "key") \
        .agg(F.min("seq").alias("first_seq"))
    return keyed.join(first, ["run_id", "bucket", "key"], "left").withColumn(
        "is_repeat", F.coalesce(F.col("seq") > F.col("first_seq"), F.lit(False))).drop("bucket", "first_seq")


QUESTION_TYPES = ("locate", "explain", "trace-call-flow")
REQUIRED_FIELDS = ("id", "repo", "question", "type", "expected_files", "reference_answer_points")


def question_problems(questions: DataFrame, repos: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-12: ``(question_id, problem)`` rows, empty for a valid set.

    ``repos(repo)``, ``files(repo, path, n_lines)``.
    """
    qid = F.coalesce("id", F.lit("<no-id>")).alias("question_id")
    known = questions.join(repos.select("repo").distinct(), "repo", "left_semi")
    problems = [
        questions.filter(F.col(f).isNull()).select(
            qid, F.lit(f"missing required field {f}").alias("problem")) for f in REQUIRED_FIELDS
    ]
    problems.append(questions.join(repos.select("repo").distinct(), "repo", "left_anti").select(
        qid, F.concat(F.lit("unknown repo "), F.coalesce("repo", F.lit(""))).alias("problem")))
    problems.append(known.filter(
        F.coalesce(~F.col("type").isin(*QUESTION_TYPES), F.lit(True))).select(
        qid, F.concat(F.lit("bad type "), F.coalesce("type", F.lit(""))).alias("problem")))
    n_points = F.greatest(F.size("reference_answer_points"), F.lit(0))
    problems.append(known.filter(~n_points.between(2, 3)).select(
        qid, F.concat(F.lit("needs 2-3 answer points, got "), n_points.cast("string")).alias("problem")))
    expected = known.select(
        "id", "repo", "expected_line_ranges", F.explode("expected_files").alias("path"))
    problems.append(expected.join(files, ["repo", "path"], "left_anti").select(
        qid, F.concat("path", F.lit(" missing")).alias("problem")))
    bad = lambda r: (F.size(r) != 2) | (r[0] > r[1])
    ranges = known.select("id", "repo", "expected_files", F.explode("expected_line_ranges").alias("range"))
    shown = F.concat(F.lit("["), F.array_join(F.transform("range", lambda x: x.cast("string")), ", "), F.lit("]"))
    problems.append(ranges.filter(bad(F.col("range"))).select(
        qid, F.concat(F.lit("malformed line range "), shown).alias("problem")))
    inside = ranges.filter(~bad(F.col("range"))).withColumn("path", F.explode("expected_files"))
    problems.append(
        inside.join(files, ["repo", "path"]).filter(F.col("range")[1] > F.col("n_lines")).select(
            qid, F.concat(F.lit("range "), shown, F.lit(" exceeds "), "path", F.lit(" ("),
                          F.col("n_lines").cast("string"), F.lit(" lines)")).alias("problem")))
    return reduce(DataFrame.unionByName, problems)


def project_rollup(files: DataFrame) -> DataFrame:
    """AGG-14."""
    return files.groupBy("project_id").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size_bytes"))
