"""Reading the corpus: ranges, grep, listings and the file tree (RET-9 .. RET-14)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscope import params as P
from corpuscope.functions.paths import base_name, natural_key, safe_path
from corpuscope.functions.text import head_chars, strip
from corpuscope.operators.lines import text_lines
from corpuscope.operators.ranks import with_positions


#: longer than any text or line count
_ALL = (1 << 31) - 1


def _count(text: Column, needle: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def read_ranges(requests: DataFrame, files: DataFrame, max_lines: int | None = None,
                max_chars: int | None = None) -> DataFrame:
    """RET-10: ``requests(request_id, project_id, path, start_line, end_line)``.

    Null bounds read the whole file.  Lines keep their own endings.  Without ``max_lines`` and
    ``max_chars`` nothing is cut; else ``truncated`` tells, and ``shown`` how many lines are left. ``status`` is ``ok``, ``not_found`` or
    ``bad_path`` (absolute, or out of the project); ``./a//b`` and back slashes are read as ``a/b``.
    """
    max_lines, max_chars = max_lines or _ALL, max_chars or _ALL
    parts = F.split("content", "\n")
    stored = files.select("project_id", F.col("path").alias("safe"), "content", F.lit(True).alias("found"))
    asked = requests.withColumn("safe", safe_path("path")).join(stored, ["project_id", "safe"], "left")
    ranged = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    rows = (
        asked.withColumn("parts", parts)
        .withColumn("total_lines", F.size("parts") - F.when(F.element_at("parts", -1) == "", 1).otherwise(0))
        .withColumn("first", F.when(ranged, F.greatest(F.col("start_line"), F.lit(1))).otherwise(1))
        .withColumn("last", F.least(F.when(ranged, F.col("end_line")).otherwise(F.col("total_lines")),
                                    F.col("total_lines")))
        .withColumn("cut_lines", (F.col("last") - F.col("first") + 1) > max_lines)
        .withColumn("last", F.when(F.col("cut_lines"), F.col("first") + (max_lines - 1)).otherwise(F.col("last")))
        .withColumn("joined", F.when(F.col("last") < F.col("first"), "").otherwise(F.concat(
            F.array_join(F.slice("parts", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n"),
            F.when(F.col("last") < F.size("parts"), "\n").otherwise(""))))
        .withColumn("truncated", F.col("cut_lines") | (F.length("joined") > max_chars))
        .withColumn("content", F.substring("joined", 1, max_chars))
        .withColumn("shown", _count(F.col("content"), "\n") + F.when(
            (F.col("content") != "") & ~F.col("content").endswith("\n"), 1).otherwise(0))
    )
    return rows.select(
        "request_id", "project_id", F.coalesce("safe", "path").alias("path"), "content",
        F.when(F.col("safe").isNull(), "bad_path").when(F.col("found"), "ok").otherwise("not_found").alias("status"),
        F.when(ranged, F.col("start_line")).alias("start_line"),
        F.when(ranged & F.col("truncated"), F.col("start_line") + F.col("shown") - 1)
        .when(ranged, F.col("end_line")).alias("end_line"),
        "total_lines", ranged.alias("partial"),
        "truncated", "shown")


def check_pattern(pattern: str, files: DataFrame) -> None:
    """Reject an empty or malformed regular expression before any job runs, by the dialect that will run it."""
    if not pattern:
        raise ValueError("pattern is required")
    try:
        files.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException) as error:
        raise ValueError(f"Invalid regular expression: {error}") from error


def _in_scope(files: DataFrame, path: str | None, max_files: int | None) -> DataFrame:
    if path is not None:
        return files.filter(F.col("path") == safe_path(F.lit(path)))
    if max_files is None:
        return files
    # first files of a project by path: the bound prunes before the shuffle
    order = W.partitionBy("project_id").orderBy("path")
    first = files.select("project_id", "file_id", "path").withColumn("position", F.row_number().over(order)) \
        .filter(F.col("position") <= max_files).select("file_id")
    return files.join(first, "file_id", "left_semi")


def grep(files: DataFrame, pattern: str, path: str | None = None,
         max_matches: int | None = None, max_files: int | None = None,
         line_chars: int | None = None) -> DataFrame:
    """RET-9: matching lines of every project by path and line.

    The pattern is a ``java.util.regex`` one. ``max_files=300, max_matches=50, line_chars=400``
    reproduce the interactive tool; by default nothing is cut.
    """
    check_pattern(pattern, files)
    found = text_lines(_in_scope(files, path, max_files)).filter(F.col("raw").rlike(pattern)).select(
        "project_id", "path", F.col("line_no").alias("line"),
        (strip("raw") if line_chars is None else head_chars(strip("raw"), line_chars)).alias("text"))
    if max_matches is None:
        return with_positions(found, ["project_id"], ["path", "line"])
    order = W.partitionBy("project_id").orderBy("path", "line")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max_matches)


def grep_summary(files: DataFrame, matches: DataFrame, max_matches: int | None = None,
                 max_files: int | None = None) -> DataFrame:
    """RET-9 notes: files scanned until the cap, capped flag, files skipped."""
    per_project = matches.groupBy("project_id").agg(
        F.count("*").alias("n_matches"), F.max("path").alias("last_path"))
    listed = files.groupBy("project_id").agg(F.count("*").alias("n_files"))
    capped = F.lit(False) if max_matches is None else F.coalesce(F.col("n_matches"), F.lit(0)) >= max_matches
    scope = _in_scope(files, None, max_files).select("project_id", "path")
    scanned = (
        scope.join(per_project, "project_id", "left")
        .groupBy("project_id").agg(
            F.count_if(~capped | (F.col("path") <= F.col("last_path"))).alias("files_scanned"),
            F.coalesce(F.max("n_matches"), F.lit(0)).alias("n_matches"),
            F.bool_or(capped).alias("capped"), F.count("*").alias("n_scope"))
    )
    return scanned.join(listed, "project_id").select(
        "project_id", "files_scanned", "n_matches", "capped",
        (F.col("n_files") - F.col("n_scope")).alias("files_skipped"))


def list_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-6: paths of every project in order, all or the first ``limit``."""
    listed = files.select("project_id", "path", "language", "size_bytes")
    if limit is None:
        return with_positions(listed, ["project_id"], ["path"])
    order = W.partitionBy("project_id").orderBy("path")
    return listed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def read_by_path(requests: DataFrame, files: DataFrame) -> DataFrame:
    """RET-14: ``status`` is ok, not_found or bad_path."""
    checked = requests.withColumn("safe", safe_path("path", rule="backend"))
    found = files.select("project_id", F.col("path").alias("safe"), "content", F.lit(True).alias("found"))
    return checked.join(found, ["project_id", "safe"], "left").select(
        "request_id", "project_id", "path",
        F.when(F.col("safe").isNull(), "bad_path").when(F.col("found"), "ok").otherwise("not_found").alias("status"),
        "content")


# --------------------------------------------------------------------------
# file tree
# --------------------------------------------------------------------------

def file_tree(files: DataFrame) -> DataFrame:
    """RET-11: every path prefix once, with parent, name and type.

    When a path is a file and also a folder of another file, the first insert
    (by path order) decides its type.  Prefixes repeat once per file below
    them; the ``min_by`` combines them before the shuffle.
    """
    parts = F.split("path", "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"),
        F.when(i == F.size(parts), "file").otherwise("directory").alias("type")))
    exploded = files.select("project_id", "file_id", "path", "size_bytes", F.inline(nodes))
    first = F.min_by(F.struct(
        "type", F.when(F.col("type") == "file", F.col("file_id")).alias("file_id"),
        F.when(F.col("type") == "file", F.col("size_bytes")).alias("size_bytes")), "path")
    return (
        exploded.groupBy("project_id", F.col("node").alias("path")).agg(first.alias("f"))
        .select("project_id", "path",
                F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"),
                base_name("path").alias("name"), "f.type", "f.file_id", "f.size_bytes")
    )


def tree_files(tree: DataFrame) -> DataFrame:
    """RET-12: file nodes."""
    return tree.filter(F.col("type") == "file")


def tree_directories(tree: DataFrame) -> DataFrame:
    """RET-12: directory nodes."""
    return tree.filter(F.col("type") == "directory")


def folders_first(tree: DataFrame) -> DataFrame:
    """RET-13: display order, as a global sort (range partitioned)."""
    return tree.orderBy("project_id", "parent", F.when(F.col("type") == "directory", 0).otherwise(1),
                        natural_key("name"), "name")


def sort_rank_key(type_="type", name="name") -> Column:
    """RET-13 as one comparable text: folder flag, then the natural key."""
    return F.concat(F.when(F.col(type_) == "directory", "0").otherwise("1"), natural_key(name))


def contains_filter(df: DataFrame, column: str, needle: str, limit: int | None = None) -> DataFrame:
    """FLT-9: case-insensitive contains; a blank needle matches nothing when
    limited (file view) and everything otherwise (title list)."""
    text = needle.strip().lower() if limit is not None else needle.lower()
    if limit is not None and not text:
        return df.limit(0)
    hits = df.filter(F.lower(F.col(column)).contains(text))
    return hits if limit is None else hits.orderBy(natural_key(column), column).limit(limit)
