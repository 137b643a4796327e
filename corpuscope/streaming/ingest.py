"""STR-6: continuous ingest of uploaded archives.

``<uploads>/<project>/<name>.zip`` -> index tables. The file source and its
checkpoint replace the job lease: a batch that failed is run again, and its rows are a
version of their own that one publish makes current, so a rerun gives the same index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscope.operators.hygiene import archive_verdicts, keep_entries
from corpuscope.session import cut_lineage, stored
from corpuscope.sources.readers import explode_archives, job_verdicts, source_files, split_failures
from corpuscope.sources.sinks import entries_of, publish, published, read_manifest, write_index, write_version

#: uploads of one micro-batch
FILES_PER_TRIGGER = 256


def judge_uploads(uploads: DataFrame, manifest: DataFrame) -> DataFrame:
    """``project_id, archive_id, uploaded_at, outcome``: ``taken``, or ``superseded`` by a newer upload of the same
    batch, or ``late``: older than the upload that the index was made from. Of equal times the last name is newer."""
    order = F.struct("uploaded_at", "archive_id")
    newest = uploads.groupBy("project_id").agg(F.max(order).alias("newest"))
    known = manifest.select("project_id", F.struct("uploaded_at", "archive_id").alias("known"))
    return uploads.join(newest, "project_id").join(known, "project_id", "left").select(
        "project_id", "archive_id", "uploaded_at",
        F.when(order < F.col("newest"), "superseded").when(order < F.col("known"), "late").otherwise("taken").alias("outcome"))


def archive_files(blobs: DataFrame, **limits) -> DataFrame:
    """``(project_id, archive_id, content)``, one archive a project -> files with an ``error`` column.

    A broken or rejected archive is one row without a path whose error names the reason.
    """
    # written once: the verdicts read the sizes alone, and no archive is opened again for its contents
    entries = stored(explode_archives(blobs.select(F.concat_ws("/", "project_id", "archive_id").alias("archive_id"), "content")))
    refused = archive_verdicts(entries, **limits).filter("rejected IS NOT NULL")
    kept = keep_entries(entries).join(refused.select("archive_id"), "archive_id", "left_anti")
    project = F.substring_index("archive_id", "/", 1).alias("project_id")
    files = source_files(kept.select(project, "path", "content"))
    return files.unionByName(
        refused.select(project, F.concat(F.lit("archive "), "rejected").alias("error")), allowMissingColumns=True)


def index_batch(blobs: DataFrame, folder: str, batch: int | str | None = None, **limits) -> None:
    """One batch: the newest upload of each project is exploded and indexed, or its failures are listed.

    A project that fails has no index any more, one that is repaired no failures. What became of every upload is
    logged under the batch (``read_uploads``); a batch that runs again replaces its log.
    """
    spark, version = blobs.sparkSession, uuid.uuid4().hex
    base = published(spark, folder)
    time = F.col("modificationTime") if "modificationTime" in blobs.columns else F.lit(None).cast("timestamp")
    blobs = blobs.withColumn("uploaded_at", time)
    judged = cut_lineage(judge_uploads(blobs.select("project_id", "archive_id", "uploaded_at"), read_manifest(spark, folder)))
    taken = judged.where("outcome = 'taken'").drop("outcome").dropDuplicates(["project_id"])
    # read by several writes; archives are small next to what indexing makes of them
    asked = taken.select(F.col("project_id").alias("p"), F.col("archive_id").alias("a"), F.col("uploaded_at").alias("u"))
    same = (F.col("project_id") == F.col("p")) & (F.col("archive_id") == F.col("a")) & F.col("uploaded_at").eqNullSafe(F.col("u"))
    files = stored(archive_files(blobs.join(asked, same, "left_semi"), **limits))
    good, failed = split_failures(files)
    verdicts = cut_lineage(job_verdicts(files))
    write_index(good.join(verdicts.where("verdict = 'ready'"), "project_id", "left_semi"), folder, version)
    write_version(failed, folder, "failed_files", version)
    publish(spark, folder, entries_of(taken, version), taken, base)
    outcome = F.when(F.col("outcome") != "taken", F.col("outcome")).otherwise(F.coalesce(F.col("verdict"), F.lit("ready")))
    judged.join(verdicts.select("project_id", "verdict"), "project_id", "left").select(
        "project_id", "archive_id", "uploaded_at", outcome.alias("outcome")
    ).write.mode("overwrite").parquet(f"{folder}/uploads/batch={version if batch is None else batch}")


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every upload: ``project_id, archive_id, uploaded_at, outcome`` (``ready``, ``failed``, ``late``, ``superseded``)."""
    return spark.read.schema("project_id string, archive_id string, uploaded_at timestamp, outcome string").parquet(f"{folder}/uploads")


def ingest(spark: SparkSession, uploads: str, folder: str, checkpoint: str, files_per_trigger: int = FILES_PER_TRIGGER) -> StreamingQuery:
    """Processes every new archive once, ``files_per_trigger`` at a time, and stops (``availableNow``)."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(uploads)
        .select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("project_id"),
                F.regexp_extract("path", r"([^/]+)$", 1).alias("archive_id"), "modificationTime", "content")
    )
    return (
        stream.writeStream.foreachBatch(lambda batch, number: index_batch(batch, folder, number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
