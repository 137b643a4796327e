"""Session construction, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a side is only broadcast when its counted rows stay below this bound
BROADCAST_MAX_ROWS = 1_000_000


def build_session(app: str = "corpuscope", cpus: int | None = None) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    cores = cpus or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # line-level work is CPU-bound: small shuffles must not shrink to one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the session's own setting first.

    A private folder is made only on a local master with nothing configured;
    on a cluster a machine-local folder would not survive a lost executor, so
    the missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="corpuscope-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows (and their partition layout) become fixed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet below the checkpoint folder and read back: a cut of lineage for wide or repetitive rows.

    A checkpoint keeps rows as they are in memory; columns that repeat (projects, paths, languages) cost next to nothing here.
    The partition layout is not kept.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """:func:`stored`, with the layout kept: ``parts`` buckets by ``key``, so that grouping by it moves nothing."""
    path, name = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}", f"dealt_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    return out


def free_unused(spark: SparkSession) -> None:
    """Lets Spark delete shuffles, broadcasts and checkpoints that nothing refers to; it does so after a collection on the driver.

    A loop of many small jobs leaves their plans and broadcasts on the driver's heap until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint behind a count of at most ``max_rows + 1`` rows.

    Beyond the bound the frame is returned unhinted and the join shuffles
    (with AQE free to pick another strategy).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpuscope-ship-"), "corpuscope.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("corpuscope", os.path.relpath(full, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
