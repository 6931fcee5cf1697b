"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which every executor sees; it is deleted when the driver ends.

    Only on a local master, where the session names none, a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    folder = f"{named.rstrip('/')}/orrery-llm-{context.applicationId}"
    if folder not in _folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


_folders: set[str] = set()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, read back: lineage is cut there.

    A lost executor costs at most the tasks that read the table, never what made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of ``df`` (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` stored with a number for each row, and the number's column.

    Spark deals files to tasks by the cores it has just then, so a number made twice may differ. This one is made once, with
    the row, and only read from then on.
    """
    (row,) = fresh(df, "row_number")
    return stored(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


#: A group is hot if more than one row in so many is in it: so many hot groups at most.
HOT_SHARE = 2000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row a key (null is a key), where ``size`` is a group's number of rows out of ``total``.

    A hot group would be one task's load in a shuffle; there are ``HOT_SHARE`` such groups at most, so they are looked up by
    broadcast, and only the rows of all others are shuffled.
    """
    hidden = fresh(rows.join(groups.select(size).limit(0), F.lit(False)), *("k" * (i + 2) for i in range(len(keys))))
    named = groups.withColumnsRenamed(dict(zip(keys, hidden, strict=True)))
    same = F.lit(True)
    for key, other in zip(keys, hidden, strict=True):
        same = same & F.col(key).eqNullSafe(F.col(other))
    is_hot = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(named.filter(is_hot))
    cool = rows.join(hot.select(*hidden), same, "left_anti").join(named.filter(~is_hot), same)
    return rows.join(hot, same).unionByName(cool).drop(*hidden)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Have shuffle files of finished steps deleted now rather than when the driver next happens to collect garbage."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes, most: int):
    """Bounds (start, end) of runs of rows whose sizes add up to ``most`` at most; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="orrery-")).resolve() / "orrery.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
