"""URL filter: pattern rules behind an index on their rarest literal token.

A rule names a host (with all its subdomains) and a path prefix in which ``*``
stands for anything but a slash. Its literal tokens are the labels of the host and the whole
segments of the path; the one that fewest URLs contain is its index key. A URL
looks its own tokens up, and only the rules found that way run their regular
expression. Everything is DataFrame work on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, action) of the registered query
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

RULE_SCHEMA = "rule string, action string"

#: rule texts up to this size are broadcast; a larger list is joined by its tokens
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Host labels and path segments; rules without a literal token sit under ''."""
    parts = F.array_union(F.split(host, r"\."), F.split(path, "/"))
    return F.array_union(parts, F.array(F.lit("")))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules with host, path, compiled pattern and literal tokens; an invalid action fails."""
    rows = [tuple(r) for r in rules]
    if wrong := [r for r in rows if r[1] not in ("allow", "block")]:
        raise ValueError(f"unknown action in {wrong[:3]}")
    frame = spark.createDataFrame(rows, RULE_SCHEMA).dropDuplicates(["rule"])
    host = F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    # a host holds no slash, so the slash put before the path cannot be taken for a part of either
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.regexp_replace(c, r"\*", r"\\E[^/]*\\Q"), F.lit(r"\E"))
    # the last part of a path prefix may be cut off inside a segment: it is no token
    segments = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda s: (s != "") & ~s.contains("*"))
    labels = F.filter(F.split(host, r"\."), lambda s: (s != "") & ~s.contains("*"))
    return frame.select(
        "rule", "action",
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host), F.lit("/"), quoted(path)).alias("pattern"),
        F.array_distinct(F.concat(labels, segments)).alias("tokens"),
    )


def index_rules(rules: DataFrame, urls: DataFrame, hint=F.broadcast) -> DataFrame:
    """One row per rule under its rarest token (counted over all URLs; ties: the smaller token)."""
    asked = hint(rules.select(F.explode("tokens").alias("token")).distinct())
    counts = (
        urls.select(F.explode(F.array_distinct(tokens_of(F.col("host"), F.col("path")))).alias("token"))
        .join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    )
    ranked = (
        rules.select("rule", "action", "pattern", F.explode_outer("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("rule", "action", "pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("key"))
    )
    return ranked.select("rule", "action", "pattern", F.col("key.token").alias("token"))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", page_id: str = "page_id",
               default: str = "allow") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` per input row.

    The longest fitting rule decides (ties: the smaller text); without one ``rule`` is null
    and the verdict is ``default``. Null URLs and URLs without ``://`` have empty host and
    path, which fit no rule with a host. Repeated rows stay repeated; other columns are not
    read; an empty table gives an empty result. Rows with the same id and URL are judged
    once, so a hot URL is one row of the token join.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    urls = rows.groupBy("page_id", "url").agg(F.count("*").alias("copies")).select(
        "page_id", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = list(rules)
    small = sum(len(rule) + 64 for rule, _ in rules) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda frame: frame)
    index = hint(index_rules(rule_table(pages.sparkSession, rules), urls, hint))
    found = (
        urls.select("*", F.explode(F.array_distinct(tokens_of(F.col("host"), F.col("path")))).alias("token"))
        .join(index, "token", "left")
        .select("page_id", "url", "copies", "host", "path", F.when(
            F.regexp_like(F.concat_ws("/", "host", "path"), F.col("pattern")),
            F.struct(F.length("rule").alias("size"), F.col("rule"), F.col("action"))).alias("hit"))
    )
    best = found.groupBy("page_id", "url", "copies", "host", "path").agg(
        F.max(F.struct(F.col("hit.size"), F.col("hit.rule"), F.col("hit.action"))).alias("hit"))
    return best.select(
        "page_id", "url", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
