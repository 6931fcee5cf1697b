"""Materialisation that survives lost executors, and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``; it is deleted when the driver ends.

    Only on a local master, where the session names none, a temporary folder is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    folder = f"{named.rstrip('/')}/orrery-{context.applicationId}"
    if folder not in _folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: iterations start from files, not from a growing lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_buckets(df: DataFrame, key: str, label: str = "table", then=lambda rows: rows) -> DataFrame:
    """``df`` stored in buckets of ``key``, as many as a shuffle has partitions: joins and sums by it then need no shuffle of these rows.

    ``then`` is applied to the rows as they are dealt, for what needs all rows of a key together.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"orrery_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    then(df.repartition(n, key)).write.bucketBy(n, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the cleaner delete shuffle files of finished jobs: it waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="orrery-")).resolve() / "orrery.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
