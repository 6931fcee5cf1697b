"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

No ring table: a key's shard follows from its 64-bit hash and the number of shards alone, and one more
shard takes rows only into itself (about one row in ``shards + 1``).

Defined results. A null key is one key like any other (hash of the empty marker), so such rows share a
shard. Equal keys always share a shard; repeated rows each get a slot of their own. A null text counts
as no bytes. An empty table gives an empty result. Columns beside the key stay as they are, but for ``shard``, ``slot`` and
``grown_shard``, which the result sets. Rows of one key are numbered in the order of a hash of all their columns, so a task that
is run again deals the same slots.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ._common import fresh, ship, table

#: Rows that one numbering task takes, about.
ROWS_A_BUCKET = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys: each round jumps ahead to the next shard count at which a key moves."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = np.asarray(keys).astype(np.uint64, copy=True)
    at = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    nxt = np.zeros(len(state), dtype=np.float64)
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = nxt[live].astype(np.int64)
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            nxt[live] = np.floor((at[live] + 1) * (float(1 << 31) / draw))
            live = live[nxt[live] < shards]
    return at.astype(np.int32)


def key_hash(key: Column) -> Column:
    """A stable signed 64-bit hash of a key of any type: the first half of the MD5 of its text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00null"))), 1, 16), 16, -10).cast("long")


def shard_of(hashes: Column, shards: int) -> Column:
    @pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(hashes)


def assign_shards(df: DataFrame, key: str, shards: int, *, rows: int | None = None) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (one more shard) and ``slot``, gapless from 0 in each shard.

    A shard is numbered in buckets of about ``ROWS_A_BUCKET`` rows, so that no task sorts a whole shard:
    the rank inside a bucket plus the number of rows in the shard's earlier buckets. ``rows`` is the number of
    rows if the caller has it. The counting pass reads the key only.
    """
    ship(df.sparkSession)
    total = df.count() if rows is None else rows
    buckets = max(1, math.ceil(total / (shards * ROWS_A_BUCKET)))
    hashed, bucket, before, rank, tie = fresh(df, "key_hash", "bucket", "before", "rank", "tie")
    mixed = key_hash(F.col(f"`{key}`"))
    # the hash of the hash, for the bucket must not follow the shard; rows of one key differ in further columns or not at all
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    placed = df.withColumns({hashed: mixed, bucket: F.pmod(F.xxhash64(mixed), F.lit(buckets)), tie: F.xxhash64(*rest)}).drop("shard", "slot", "grown_shard")
    placed = placed.withColumns({"shard": shard_of(F.col(hashed), shards), "grown_shard": shard_of(F.col(hashed), shards + 1)})
    counts = placed.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(rank))
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", bucket, F.coalesce(F.sum(rank).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy("shard", bucket).orderBy(hashed, tie)
    ranked = placed.withColumn(rank, F.row_number().over(inside).cast("long") - 1)
    return ranked.join(offsets, ["shard", bucket]).withColumn("slot", F.col(before) + F.col(rank)).drop(hashed, bucket, before, rank, tie)


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``key``."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign_shards(slim, "doc_id", 8, rows=docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
