"""Versioned Parquet snapshots of the stored relations: hash diff, replacement of files, a fence against stale writers.

The files of a version are never changed; each version has a small file of its own number that names its tables, and the largest
complete one counts. No older file is touched, so readers always find a version and keep the one they opened. A writer states the
version it read and creates the next file, which only one can; any other is refused.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OWNERS, TABLES, conform


#: Seconds after which a version file that is not complete was left by a writer that is gone.
ABANDONED_S = 60


class StaleVersion(RuntimeError):
    """The tables changed after the writer read them."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, fs = self._fs(self.root)
        if not fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(folder))
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"VERSION-(\d{12})", n))), reverse=True)

    def _read_version(self, number: int) -> dict | None:
        """What the version file says; null if it is not complete."""
        try:
            return json.loads("".join(r[0] for r in self.spark.read.text(self._version_file(number)).collect()))
        except json.JSONDecodeError:
            return None

    def state(self) -> dict:
        """The newest version that is complete."""
        for number in self._numbers():
            if found := self._read_version(number):
                return found
        return {"version": 0, "tables": {}}

    def _version_file(self, number: int) -> str:
        return f"{self.root}/VERSION-{number:012d}"

    @property
    def version(self) -> int:
        return self.state()["version"]

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        folder = (state or self.state())["tables"].get(table)
        if folder is None:
            return conform(self.spark.createDataFrame([], TABLES[table]), table)
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{folder}")

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        """Write new contents of some tables as one version; returns it."""
        state = self.state()
        if state["version"] != expected:
            raise StaleVersion(f"version is {state['version']}, not {expected}")
        folders = dict(state["tables"])
        for name, df in tables.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            conform(df, name).write.option("compression", "zstd").parquet(f"{self.root}/{folders[name]}")
        now = self.state()
        if now["version"] != expected:
            raise StaleVersion(f"version is {now['version']}, not {expected}")
        number = expected + 1
        while True:
            path, fs = self._fs(self._version_file(number))
            try:
                # of several writers one creates the file
                out = fs.create(path, False)
            except Py4JJavaError as error:
                if not fs.exists(path):
                    raise
                writing = self._read_version(number) is not None or time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < ABANDONED_S
                if writing:
                    raise StaleVersion(f"version {number} was written by another one") from error
                number += 1
                continue
            out.write(bytearray(json.dumps({"version": number, "tables": folders}), "utf-8"))
            out.close()
            return number

    def replace(self, table: str, paths: DataFrame, rows: DataFrame, expected: int) -> int:
        """The rows of some files in one table only; all other tables stay as they are."""
        old = self.read(table)
        for owner in OWNERS[table]:
            old = old.join(paths.select(F.col("path").alias(owner)).distinct(), owner, "left_anti")
        return self.commit({table: conform(old, table).unionByName(conform(rows, table))}, expected)

    def replace_files(self, changed: DataFrame, new: dict[str, DataFrame], expected: int, removed: DataFrame | None = None) -> int:
        """Rows of changed and removed paths go (references at either end), new rows come, as one version."""
        state = self.state()
        gone = changed.select("path") if removed is None else changed.select("path").union(removed.select("path"))
        gone = gone.distinct()
        out = {}
        for name, owners in OWNERS.items():
            old = self.read(name, state)
            for owner in owners:
                old = old.join(gone.withColumnRenamed("path", owner), owner, "left_anti")
            out[name] = conform(old, name).unionByName(conform(new[name], name)) if name in new else conform(old, name)
        out |= {name: df for name, df in new.items() if name not in OWNERS}
        return self.commit(out, expected)

    def replace_refs(self, src_path: str, symbol: str | None, refs: DataFrame, expected: int) -> int:
        """A source's edges (of one symbol, if given) are replaced, unless the version moved."""
        old = self.read("refs")
        same = F.col("src_path") == src_path
        if symbol is not None:
            same = same & (F.col("symbol_name") == symbol)
        return self.commit({"refs": old.filter(~same).unionByName(conform(refs, "refs"))}, expected)

    def put_meta(self, values: dict[str, str], expected: int) -> int:
        """Upsert; no new version if nothing changes."""
        old = {r["key"]: r["value"] for r in self.read("meta").collect()}
        if all(old.get(k) == v for k, v in values.items()):
            return expected
        return self.commit({"meta": self.spark.createDataFrame(list((old | values).items()), TABLES["meta"])}, expected)


def hash_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(``path``, ``status``): new, changed, same or removed, from (``path``, ``content_hash``) now and before; one full join."""
    a = now.select("path", F.col("content_hash").alias("h1"))
    b = before.select("path", F.col("content_hash").alias("h0"))
    joined = a.join(b, "path", "full")
    status = F.when(F.col("h1").isNull(), "removed").when(F.col("h0").isNull(), "new").when(F.col("h0") != F.col("h1"), "changed").otherwise("same")
    return joined.select("path", status.alias("status"))


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(``table_name``, ``rows``), one scan a table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key: upsert semantics by one aggregation with map-side combine."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def listing(spark: SparkSession, stores: dict[str, str]) -> DataFrame:
    """(``project``, ``version``, ``files``, ``symbols``, ``error``) of several stores, from each one's version and row counts; a store that can't be read is a row with its error."""
    rows = []
    for project, root in sorted(stores.items()):
        try:
            t = Snapshots(spark, root)
            state = t.state()
            rows.append((project, state["version"], t.read("files", state).count(), t.read("symbols", state).count(), None))
        except Exception as error:
            rows.append((project, None, None, None, type(error).__name__))
    return spark.createDataFrame(rows, "project string, version long, files long, symbols long, error string")
