"""Registered queries: archives, and streaming replays of the event log."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.hygiene import accepted_entries
from corpuscope.plans.activity import FOLD_RESULT_SQL, _job_events, _requests
from corpuscope.plans.registry import ORACLES, Tables, query
from corpuscope.session import ensure_checkpoint_dir, stored
from corpuscope.sources.readers import (
    BATCH_BYTES, explode_archives, job_verdicts, kept_archive_files, source_files, split_failures)
from corpuscope.streaming.lifecycle import stream_job_states, stream_progress
from corpuscope.streaming.limiter import stream_rate_limit

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- archives: every document becomes one small archive ------------------------

def _zip_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(ids: list[str], blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(blobs, pa.binary())], names=["archive_id", "content"])

    for batch in batches:
        ids, blobs, size = [], [], 0
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_id, text = doc_id.as_py(), text.as_py()
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"src/doc_{doc_id}.md", text)
                archive.writestr("src/", "")
                archive.writestr(".git/HEAD", "ref")
                archive.writestr("conf/.env", "SECRET=1")
                archive.writestr("../escape.md", text)
                if doc_id % 10 == 0:
                    archive.writestr("src/broken.md", b"ok\xc3")
            ids.append(str(doc_id))
            blobs.append(held.getvalue())
            size += len(blobs[-1])
            if size > BATCH_BYTES:
                yield table(ids, blobs)
                ids, blobs, size = [], [], 0
        if ids:
            yield table(ids, blobs)


def _archives(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", "text").mapInArrow(
        _zip_documents, "archive_id string, content binary")


@query("archive_entries", """
WITH d AS (SELECT doc_id::VARCHAR AS archive_id, doc_id, octet_length(encode(text))::BIGINT AS n FROM documents)
SELECT archive_id, 'src/doc_' || doc_id || '.md' AS path, n AS size FROM d
UNION ALL SELECT archive_id, 'src/', 0 FROM d UNION ALL SELECT archive_id, '.git/HEAD', 3 FROM d
UNION ALL SELECT archive_id, 'conf/.env', 8 FROM d UNION ALL SELECT archive_id, '../escape.md', n FROM d
UNION ALL SELECT archive_id, 'src/broken.md', 3 FROM d WHERE doc_id % 10 = 0""")
def archive_entries(t: Tables) -> DataFrame:
    """SRC-1: every entry and its size."""
    return explode_archives(_archives(t)).select("archive_id", "path", "size")


@query("archive_files", """
SELECT doc_id::VARCHAR AS archive_id, 'src/doc_' || doc_id || '.md' AS path, md5(text) AS content_hash FROM documents
  WHERE octet_length(encode(text)) <= 1000000
UNION ALL SELECT doc_id::VARCHAR, 'src/broken.md', md5(from_hex('6F6BC3')) FROM documents WHERE doc_id % 10 = 0 AND octet_length(encode(text)) <= 1000000""")
def archive_files(t: Tables) -> DataFrame:
    """SRC-1 + FLT-1 .. FLT-4: kept files of the accepted archives."""
    kept = kept_archive_files(accepted_entries(explode_archives(_archives(t))))
    return kept.select("archive_id", "path", F.md5("content").alias("content_hash"))


@query("failed_files", """
SELECT doc_id::VARCHAR AS project_id, 'src/broken.md' AS path, 'failed' AS verdict FROM documents WHERE doc_id % 10 = 0""")
def failed_files(t: Tables) -> DataFrame:
    """IDX-7, SRC-5: malformed files are listed and fail their project."""
    entries = kept_archive_files(explode_archives(_archives(t)))
    # fixed once without the contents: the list and the verdicts both read it
    files = stored(source_files(entries.select(F.col("archive_id").alias("project_id"), "path", "content")).select("project_id", "path", "error"))
    failed = split_failures(files)[1]
    return failed.join(job_verdicts(files), "project_id").select("project_id", "path", "verdict")


# ---- streaming replays ----------------------------------------------------------

def _event_stream(t: Tables) -> DataFrame:
    reader = t.spark.readStream.schema(t.events.schema)
    if any(path.endswith("/events.parquet") for path in t.events.inputFiles()):
        # stored as one file: the stream watches its folder
        return reader.option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return reader.parquet(f"{t.folder}/events.parquet")


def _drain(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream to its end; the written batches are the result."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    root = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:  # a batch that is tried again replaces itself
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    # a replay of one table: state partitions beyond the cores only cost start-up
    partitions = t.spark.conf.get("spark.sql.shuffle.partitions")
    t.spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), t.spark.sparkContext.defaultParallelism)))
    try:
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint") \
            .trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return t.spark.read.parquet(f"{root}/out")


class _Stream(Tables):
    """The same tables with ``events`` as a stream."""

    def __getattr__(self, name: str) -> DataFrame:
        return _event_stream(Tables(self.spark, self.folder)) if name == "events" else super().__getattr__(name)


@query("rate_limit_stream", ORACLES["rate_limit"])
def rate_limit_stream(t: Tables) -> DataFrame:
    """STR-1 as a stream; equal to the batch form on an ordered replay."""
    limits = {"AUTH": 1, "CHAT": 1, "AGENT": 1, "SEARCH": 1}
    stream = stream_rate_limit(_requests(_Stream(t.spark, t.folder)), limits, window_ms=86_400_000)
    return _drain(t, stream, "append").select(
        "request_id", "window_start_ms", "request_no", "allowed", "retry_after_s")


@query("job_state_stream", FOLD_RESULT_SQL)
def job_state_stream(t: Tables) -> DataFrame:
    """STR-2, STR-3 as a stream: the last emitted state of every job."""
    states = _drain(t, stream_job_states(_job_events(_Stream(t.spark, t.folder))), "update")
    last = F.max_by(F.struct("status", "attempts", "progress_percent", "next_run_ms", "locked_ms"), "batch")
    return states.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")


@query("progress_stream", ORACLES["progress_latest"])
def progress_stream(t: Tables) -> DataFrame:
    """STR-5 as a stream in update mode."""
    events = _job_events(_Stream(t.spark, t.folder)).select("job_id", "event_id", "ts", "percent")
    states = _drain(t, stream_progress(events), "update")
    return states.groupBy("job_id").agg(F.max_by(F.struct("progress_percent", "locked_at"), "batch").alias("s")) \
        .select("job_id", "s.*")

