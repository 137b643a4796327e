"""Citations: extraction, matching, scoring, tiered resolution (CIT-1 .. CIT-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.paths import base_name, citation_key, segment_suffixes
from corpuscope.functions.text import _c, let

# ---- fixed values: citation grammars ---------------------------------------
ANSWER_EXTENSIONS = "java|py|ts|tsx|js|jsx|go|rs|cpp|c|h|cs|rb|php|kt|scala|sh|yml|yaml"
UI_EXTENSIONS = (
    "java|py|js|ts|jsx|tsx|css|html|md|json|go|rs|c|cpp|h|cs|rb|php|kt|scala|sh|yml|yaml"
)
# ---------------------------------------------------------------------------


def _patterns(strict: bool) -> tuple[str, str, str]:
    edge = r"\b" if strict else ""
    path = rf"([\w./-]+\.(?:{ANSWER_EXTENSIONS}){edge})"
    quote = '(?:`|")?'
    return (
        rf"{quote}{path}(?::(\d+)(?:-(\d+))?){quote}",
        rf"{quote}{path}(?:\s*\(line[s]?\s+(\d+)(?:\s*-\s*(\d+))?\))?{quote}",
        rf"`{path}`",
    )


def _number(text: Column) -> Column:
    return F.when(text != "", text.try_cast("int"))


def _pass(text: Column, pattern: str, number: int, ranged: bool) -> Column:
    def group(n):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

    if not ranged:
        return F.transform(group(1), lambda p: F.struct(
            F.lit(number).alias("pass"), p.alias("path"),
            F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")))
    zipped = F.arrays_zip(group(1).alias("path"), group(2).alias("a"), group(3).alias("b"))
    return F.transform(zipped, lambda z: F.struct(
        F.lit(number).alias("pass"), z["path"].alias("path"),
        _number(z["a"]).alias("start_line"), _number(z["b"]).alias("end_line")))


def citations_of(text, strict: bool = False) -> Column:
    """CIT-1: array of struct(pass, path, start_line, end_line).

    ``path:n[-m]`` matches are all kept; the two looser forms only add paths
    not seen before.  ``strict`` asks for a word boundary after the extension;
    without it ``a.tsx`` without a line number is read as ``a.ts``.
    """
    text = _c(text)
    colon, paren, tick = _patterns(strict)
    exact = _pass(text, colon, 1, True)
    loose = F.concat(_pass(text, paren, 2, True), _pass(text, tick, 3, False))

    def merge(found: Column) -> Column:
        known = F.transform(found["exact"], lambda x: x["path"])
        paths = F.transform(found["loose"], lambda x: x["path"])
        return let(F.struct(known.alias("known"), paths.alias("paths")), lambda p: F.concat(
            found["exact"], F.filter(found["loose"], lambda item, i: (
                ~F.array_contains(p["known"], item["path"])
                & (F.array_position(p["paths"], item["path"]) == i + 1)))))

    return let(F.struct(exact.alias("exact"), loose.alias("loose")), merge)


def extract_citations(answers: DataFrame, text: str = "answer", strict: bool = False) -> DataFrame:
    """One row per citation, ``position`` in extraction order."""
    keep = [c for c in answers.columns if c != text]
    return answers.select(*keep, F.posexplode(citations_of(text, strict)).alias("position", "c")).select(
        *keep, "position", F.col("c.pass").alias("pass"), F.col("c.path").alias("cited_path"),
        "c.start_line", "c.end_line")


def matches_expected(cited, expected) -> Column:
    """CIT-2: equal normalised path, or equal base name."""
    norm = citation_key(cited)
    return F.exists(_c(expected), lambda e: (
        (norm == citation_key(e)) | (norm == base_name(e)) | (base_name(norm) == base_name(e))))


def score_citations(answers: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """CIT-3 per citation: ``answers(question_id, repo, answer, expected_files)``.

    Existence (exact or ``/suffix``) is an equi-join with the exploded path
    suffixes, reduced to those that are cited at all.
    """
    cited = extract_citations(answers, "answer", strict).withColumn("key", citation_key("cited_path"))
    wanted = cited.select("repo", "key").distinct()
    existing = (
        files.select(F.col("project_id").alias("repo"), F.explode(segment_suffixes("path")).alias("key"))
        .join(wanted, ["repo", "key"], "left_semi").distinct().withColumn("exists_in_repo", F.lit(True))
    )
    scored = cited.join(existing, ["repo", "key"], "left").withColumn(
        "exists_in_repo", F.coalesce("exists_in_repo", F.lit(False))).withColumn(
        "in_expected", matches_expected("cited_path", "expected_files"))
    return scored.withColumn("correct", F.col("exists_in_repo") & F.col("in_expected")).drop("key", "expected_files")


def citation_accuracy(answers: DataFrame, scored: DataFrame) -> DataFrame:
    """CIT-3 per question: 0 when nothing is cited."""
    per = scored.groupBy("question_id").agg(
        F.count("*").alias("cited"), F.count_if("correct").alias("correct"))
    return answers.select("question_id").join(per, "question_id", "left").select(
        "question_id", F.coalesce("cited", F.lit(0)).alias("cited"),
        F.coalesce("correct", F.lit(0)).alias("correct"),
        F.coalesce(F.col("correct") / F.col("cited"), F.lit(0.0)).alias("accuracy"))


def _tiers(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Asked keys that some path answers to, each with its first path and hit count; keys that nobody asks for are dropped at once."""
    suffixes = segment_suffixes("path")
    proper = F.slice(suffixes, F.lit(2), F.size(suffixes))

    def rows(tier: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(tier).alias("tier"), k.alias("key")))

    keys = F.concat(rows(1, F.array("path")), rows(2, proper), rows(3, F.array(base_name("path"))))
    asked = probes.select("project_id", "tier", "key").distinct()
    return files.select("project_id", "path", F.inline(keys)).join(asked, ["project_id", "tier", "key"], "left_semi") \
        .groupBy("project_id", "tier", "key").agg(F.min("path").alias("hit"), F.count("*").alias("hits"))


def resolve_citations(cited: DataFrame, files: DataFrame) -> DataFrame:
    """CIT-4: ``cited(project_id, cited_path)`` -> path, tier, n_others.

    Exact path, then path suffix, then base name; the first tier with a hit
    wins.  An exact hit counts longer paths ending in it as ``n_others``;
    :func:`other_hits` lists them.
    """
    asked = cited.select("project_id", "cited_path").distinct() \
        .withColumn("key", F.replace("cited_path", F.lit("\\"), F.lit("/")))
    probes = asked.select("project_id", "cited_path", F.inline(F.array(
        F.struct(F.lit(1).alias("tier"), F.col("key").alias("key")),
        F.struct(F.lit(2).alias("tier"), F.col("key").alias("key")),
        F.struct(F.lit(3).alias("tier"), base_name("key").alias("key")))))
    found = probes.join(_tiers(files, probes), ["project_id", "tier", "key"])
    suffix_hits = F.coalesce(F.max(F.when(F.col("tier") == 2, F.col("hits"))), F.lit(0))
    best = F.min_by(F.struct("tier", "hit", "hits"), "tier")
    return (
        found.groupBy("project_id", "cited_path").agg(best.alias("best"), suffix_hits.alias("suffix_hits"))
        .select("project_id", "cited_path", F.col("best.hit").alias("path"), F.col("best.tier").alias("tier"),
                F.when(F.col("best.tier") == 1, F.col("suffix_hits")).otherwise(F.col("best.hits") - 1)
                .alias("n_others"))
    )


def other_hits(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """CIT-4: the remaining hits of the winning tier, one row each."""
    asked = resolved.select(
        "project_id", "cited_path", F.col("path").alias("chosen"), "tier",
        F.when(F.col("tier") == 3, base_name(F.replace("cited_path", F.lit("\\"), F.lit("/"))))
        .otherwise(F.replace("cited_path", F.lit("\\"), F.lit("/"))).alias("key"),
        F.when(F.col("tier") == 3, 3).otherwise(2).alias("list"))
    suffixes = segment_suffixes("path")
    keys = F.concat(
        F.transform(F.slice(suffixes, F.lit(2), F.size(suffixes)),
                    lambda k: F.struct(F.lit(2).alias("list"), k.alias("key"))),
        F.array(F.struct(F.lit(3).alias("list"), base_name("path").alias("key"))))
    hits = files.select("project_id", F.col("path").alias("other_path"), F.inline(keys))
    return asked.join(hits, ["project_id", "list", "key"]).filter(
        F.col("other_path") != F.col("chosen")).select("project_id", "cited_path", "chosen", "other_path")


def inline_citations_of(text) -> Column:
    """CIT-5 grammar: array of struct(path, start_line, end_line)."""
    text = _c(text)
    path = rf"([\w./-]+\.(?:{UI_EXTENSIONS}))"
    pattern = rf"{path}:(\d+)(?:-(\d+))?|{path} \(line (\d+)\)"

    def group(n):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

    zipped = F.arrays_zip(*[group(n).alias(f"g{n}") for n in range(1, 6)])

    def row(z: Column) -> Column:
        start = F.coalesce(_number(z["g2"]), _number(z["g5"]))
        return F.struct(
            F.when(z["g1"] != "", z["g1"]).otherwise(z["g4"]).alias("path"),
            start.alias("start_line"), F.coalesce(_number(z["g3"]), start).alias("end_line"))

    return F.transform(zipped, row)


def inline_citations(messages: DataFrame, files: DataFrame, text: str = "answer") -> DataFrame:
    """CIT-5: citations that resolve to a project file."""
    keep = [c for c in messages.columns if c != text]
    found = messages.select(*keep, F.posexplode(inline_citations_of(text)).alias("position", "c")).select(
        *keep, "position", F.col("c.path").alias("cited_path"), "c.start_line", "c.end_line")
    return found.join(resolve_citations(found, files), ["project_id", "cited_path"])
