"""Corpus hygiene over entry tables (FLT-1 .. FLT-4, FLT-7, FLT-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import params as P
from corpuscope.functions.paths import escapes_root, is_ignored
from corpuscope.functions.text import _c


def keep_entries(entries: DataFrame) -> DataFrame:
    """FLT-1 .. FLT-3 and the archive-slip rule on ``(archive_id, path, ...)``."""
    return entries.filter(~_c("path").endswith("/") & ~is_ignored("path") & ~escapes_root("path"))


def archive_verdicts(entries: DataFrame, max_file: int = P.MAX_FILE_BYTES,
                     max_total: int = P.MAX_ARCHIVE_BYTES, max_files: int = P.MAX_ARCHIVE_FILES) -> DataFrame:
    """FLT-4: one verdict per archive over *all* its entries.

    ``entries(archive_id, entry_no, path, size)`` in archive order; an ``error`` column, where
    there is one, rejects the archive as broken whatever could be read before.  The count
    limit breaks when any entry follows the last allowed kept file; with fewer
    kept files than the limit it cannot.
    """
    kept = ~_c("path").endswith("/") & ~is_ignored("path")
    stored = kept & ~escapes_root("path")
    marked = entries.withColumns({"kept": kept, "stored": stored})
    broken = F.bool_or(F.col("error").isNotNull()) if "error" in entries.columns else F.bool_or(F.lit(False))
    totals = marked.groupBy("archive_id").agg(
        broken.alias("broken"),
        F.count_if("stored").alias("kept_files"),
        F.coalesce(F.sum(F.when(F.col("stored"), F.col("size"))), F.lit(0)).alias("kept_bytes"),
        F.coalesce(F.max(F.when(F.col("kept"), F.col("size"))), F.lit(0)).alias("largest"),
        F.max("entry_no").alias("last_entry"),
        F.max(F.when(F.col("stored"), F.col("entry_no"))).alias("last_kept"))
    # exactly at the limit: the archive only fails when an entry follows
    full = (F.col("kept_files") > max_files) | (
        (F.col("kept_files") == max_files) & (F.col("last_entry") > F.col("last_kept")))
    reason = (
        F.when(F.col("broken"), "broken")
        .when(F.col("largest") > max_file, "file_too_large")
        .when(F.col("kept_bytes") > max_total, "archive_too_large")
        .when(full, "too_many_files"))
    return totals.select("archive_id", "kept_files", "kept_bytes", "largest", reason.alias("rejected"))


def accepted_entries(entries: DataFrame, **limits) -> DataFrame:
    """Kept entries of the archives that pass FLT-4."""
    rejected = archive_verdicts(entries, **limits).filter("rejected IS NOT NULL").select("archive_id")
    return keep_entries(entries).join(rejected, "archive_id", "left_anti")


def in_project(df: DataFrame, project_id) -> DataFrame:
    """FLT-7: scope injection; partition pruning on tables partitioned by project."""
    return df.filter(_c("project_id") == (project_id if isinstance(project_id, Column) else F.lit(project_id)))


def ready_only(df: DataFrame, projects: DataFrame) -> DataFrame:
    """FLT-8."""
    return df.join(projects.filter(F.col("status") == "ready").select("project_id"), "project_id", "left_semi")
