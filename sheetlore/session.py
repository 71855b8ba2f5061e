"""Session settings and the few helpers that depend on the running cluster."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytecode of the largest method that the JVM compiles; it interprets a larger one, several times slower.
COMPILED_METHOD = 8000


def build_session(app_name: str = "sheetlore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; every setting can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.codegen.hugeMethodLimit": str(COMPILED_METHOD),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_stages_compiled(spark: SparkSession) -> None:
    """Run a stage of many wide expressions in pieces if its one method would be too large for the JVM to compile.

    For sessions that were not built here; wide mapped tables pass the bound with few expressions on top.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > COMPILED_METHOD:
        spark.conf.set(key, COMPILED_METHOD)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files that a write inside shuffles are removed when it ends, not when the driver happens to collect its garbage.

    For jobs of several large writes, whose shuffles would otherwise lie on the disks all at once.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for ``DataFrame.checkpoint``.

    A cluster names a shared folder in ``spark.checkpoint.dir`` and that one is used. A
    folder on the local disk is taken only by a local master, where every task can read it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_sheetlore_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "sheetlore.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(archive))
    context._sheetlore_shipped = True


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of what lies in a folder of any file system Spark reads; nothing if there is none."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(folder))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a bare scan, the size of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, least_bytes: int = 4 * 1024 * 1024) -> DataFrame:
    """Redistribute a scan that yields fewer tasks than there are cores.

    A table that fills at least one split per core is returned as it is, and so is one that
    is too small to be worth a shuffle. Filters and column selection still reach the scan.
    """
    spark = df.sparkSession
    size, cores = estimated_bytes(df), spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if least_bytes <= size < split * cores else df


def is_small(written: DataFrame, most_rows: int = 50_000, most_bytes: int = 8 * 1024 * 1024) -> bool:
    """Whether a table that was written has at most so many rows and bytes; no more than ``most_rows`` + 1 rows are looked at."""
    measured = written.limit(most_rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
    return measured["n"] <= most_rows and (measured["size"] or 0) <= most_bytes


def small_side(df: DataFrame, most_rows: int = 50_000, most_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """``df`` evaluated once and, when it is small, marked for broadcast.

    For join sides that are derived by aggregation, whose size the optimizer cannot know in
    advance: a table of one row per map may be tiny or huge, and rows may hold long arrays.
    """
    written = cut_lineage(df)
    return F.broadcast(written) if is_small(written, most_rows, most_bytes) else written
