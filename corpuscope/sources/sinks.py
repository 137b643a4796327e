"""Index sinks (SRC-7 .. SRC-10): versioned tables behind a manifest.

``<folder>/<table>/version=<v>/`` holds the rows that one write made, projects side by side, and is never changed. The manifest
names the version that counts for each project; ``manifests/<n>.published`` makes it current in one step. A write
that fails leaves files that nothing refers to, and readers keep the index they had.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.operators.chunking import attach_embeddings, chunk_files
from corpuscope.operators.references import references_of
from corpuscope.operators.scan import scan
from corpuscope.operators.symbols import structure, symbols_of
from corpuscope.schemas import CHUNKS, FAILED_FILES, FILES, MANIFEST, REFERENCES, SYMBOLS
from corpuscope.session import stored

SCHEMAS = {"files": FILES, "chunks": CHUNKS, "code_symbols": SYMBOLS, "code_references": REFERENCES, "failed_files": FAILED_FILES}
#: tables of an indexed project; ``failed_files`` stands in for them where a project failed
TABLES = ("files", "chunks", "code_symbols", "code_references")


class IndexConflict(RuntimeError):
    """Another writer published first; nothing of this write is visible."""


# -- manifest ---------------------------------------------------------------------
def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def published(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and folder name of the current manifest; (0, None) before the first write."""
    numbers = [int(m[1]) for m in (re.fullmatch(r"(\d+)\.published", n) for n in _names(spark, f"{folder}/manifests")) if m]
    if not numbers:
        return 0, None
    number = max(numbers)
    fs, marker = _file_system(spark, f"{folder}/manifests/{number}.published")
    stream = fs.open(marker)
    try:
        return number, stream.readUTF()
    finally:
        stream.close()


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``project_id, version, uploaded_at, archive_id``: one row for each project of the index."""
    name = published(spark, folder)[1]
    if name is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifests/{name}")


def publish(spark: SparkSession, folder: str, entries: DataFrame, gone: DataFrame, base: tuple[int, str | None]) -> None:
    """Makes ``base`` less the projects of ``gone``, plus ``entries``, the current manifest.

    The marker is created only where none is: of two writers that began with one base, the second fails.
    """
    number, name = base
    before = spark.createDataFrame([], MANIFEST) if name is None else spark.read.schema(MANIFEST).parquet(f"{folder}/manifests/{name}")
    new = f"{number + 1}-{uuid.uuid4().hex}"
    before.join(gone.select("project_id").distinct(), "project_id", "left_anti").unionByName(
        entries.select([f.name for f in MANIFEST])).write.parquet(f"{folder}/manifests/{new}")
    fs, marker = _file_system(spark, f"{folder}/manifests/{number + 1}.published")
    try:
        stream = fs.create(marker, False)
    except Exception as error:
        raise IndexConflict(f"manifest {number + 1} of {folder} was published by another writer") from error
    stream.writeUTF(new)
    stream.close()


def read_index(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The current rows of an index table, with its declared schema (also where it holds none)."""
    schema, number = SCHEMAS[name], published(spark, folder)[0]
    fs, target = _file_system(spark, os.path.join(folder, name))
    if not number or not fs.exists(target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())])).parquet(os.path.join(folder, name))
    return rows.join(read_manifest(spark, folder).select("project_id", "version"), ["project_id", "version"], "left_semi").select(schema.names)


# -- writes -----------------------------------------------------------------------
def write_version(df: DataFrame, folder: str, name: str, version: str) -> None:
    """SRC-7: the rows of one table of a version. Projects lie together and in order, so a reader of one skips the files and
    row groups of others; files are as many as the bytes need, however many projects there are, and a huge project has several."""
    df.hint("rebalance", "project_id").sortWithinPartitions("project_id").write.parquet(os.path.join(folder, name, f"version={version}"))


def _stored(spark: SparkSession, folder: str, name: str, version: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(folder, name, f"version={version}"))


def write_index(files: DataFrame, folder: str, version: str, strict: bool = False, dim: int | None = None) -> None:
    """All index tables of ``files`` under a version that is not published yet.

    The files are written first and read back for the rest, so their source is read once. Their symbols and references are found in one
    pass and fixed once; chunks are cut out in a pass of their own, so no text is moved or stored for them.
    """
    spark = files.sparkSession
    write_version(files.select(FILES.names), folder, "files", version)
    files = _stored(spark, folder, "files", version)
    found = stored(scan(files, strict))
    items = structure(found, strict)
    embedded = {} if dim is None else {"dim": dim}
    write_version(symbols_of(items).select(SYMBOLS.names), folder, "code_symbols", version)
    write_version(references_of(found, items, strict).select(REFERENCES.names), folder, "code_references", version)
    chunks = chunk_files(files, strict=strict, scanned=True)
    write_version(attach_embeddings(chunks, **embedded).select(CHUNKS.names), folder, "chunks", version)


def index_projects(files: DataFrame, folder: str, strict: bool = False, dim: int | None = None) -> str:
    """SRC-8: (re)index every project in ``files``; never appends. Returns the version.

    The old rows of these projects count until the new ones are complete, then none of them do, in any table.
    """
    spark, version = files.sparkSession, uuid.uuid4().hex
    base = published(spark, folder)
    write_index(files, folder, version, strict, dim)
    projects = _stored(spark, folder, "files", version).select("project_id").distinct()
    publish(spark, folder, entries_of(projects, version), projects, base)
    return version


def entries_of(projects: DataFrame, version: str) -> DataFrame:
    """Manifest rows of ``projects``; the upload's time and name where they are known."""
    known = [F.col(f.name) if f.name in projects.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST if f.name != "version"]
    return projects.select(*known, F.lit(version).alias("version"))


def purge_projects(spark: SparkSession, folder: str, purged: DataFrame) -> None:
    """SRC-9: the given projects leave the index, in one step for all tables; :func:`compact` removes their files."""
    publish(spark, folder, spark.createDataFrame([], MANIFEST), purged, published(spark, folder))


def without_projects(table: DataFrame, purged: DataFrame) -> DataFrame:
    """SRC-9 as a view: the table less the purge list."""
    return table.join(purged.select("project_id").distinct(), "project_id", "left_anti")


def compact(spark: SparkSession, folder: str) -> None:
    """Rewrites the current rows as one version and deletes all others, once no reader uses them any more."""
    base, version = published(spark, folder), uuid.uuid4().hex
    if base[1] is None:
        return
    for name in SCHEMAS:
        if _names(spark, os.path.join(folder, name)):
            write_version(read_index(spark, folder, name), folder, name, version)
    projects = read_manifest(spark, folder)
    publish(spark, folder, entries_of(projects.drop("version"), version), projects, base)
    vacuum(spark, folder)


def vacuum(spark: SparkSession, folder: str) -> None:
    """Deletes manifests before the current one and versions that it does not name. The driver sees version names."""
    number, current = published(spark, folder)
    used = {f"version={r.version}" for r in read_manifest(spark, folder).select("version").distinct().collect()}
    for name in SCHEMAS:
        for version in _names(spark, os.path.join(folder, name)):
            if version not in used and version.startswith("version="):
                _delete(spark, os.path.join(folder, name, version))
    for name in _names(spark, f"{folder}/manifests"):
        if name not in (current, f"{number}.published"):
            _delete(spark, f"{folder}/manifests/{name}")


# -- evaluation -------------------------------------------------------------------
def write_results(aggregate: DataFrame, per_question: DataFrame, folder: str) -> None:
    """SRC-10: aggregate and per-question results as JSON tables."""
    aggregate.write.mode("overwrite").json(os.path.join(folder, "eval_aggregate"))
    per_question.write.mode("overwrite").json(os.path.join(folder, "eval_results"))
