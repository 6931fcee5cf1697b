"""Exact deduplication by deterministic block naming (after Karp, Miller and Rosenberg), in DataFrame functions only.

A normalised text is cut into blocks of ``BLOCK`` bytes. The distinct blocks are sorted and named by integers; then
adjacent names are paired and the distinct pairs named in the same way, until each document has one name. Names are
ranks in a sort, never hashes, so equal identities mean equal texts. Hashes only deal rows to tasks.

Hot groups. Blocks that more than one in ``HOT_SHARE`` rows hold are at most ``HOT_SHARE`` many (4 MB of text); they are found
by a count with map-side combine, named apart and looked up by broadcast, so that no task gathers their rows. Hot pairs of
names and hot groups of copies are looked up in the same way. Copies are never expanded into pairs.

Defined results. A null text counts as empty; all texts that are empty after normalisation are one group. Of rows that
tie in code points the smallest id stays (a null id after all others). Rows repeated with the same id and text share the
group; one of them stays. Empty tables give empty results; further columns, whatever their names, do not matter
and stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import HOT_SHARE, numbered, stored, table, with_group

#: Bytes of a block.
BLOCK = 2048
#: No block is hot under so many rows.
HOT_LEAST = 1000
#: Rows of a naming task, about.
ROWS_A_TASK = 20_000


def normalised(text: Column) -> Column:
    """The text without the six ASCII white-space characters."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _blocks(df: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """``row`` (one number a row, as given), ``pos``, ``last`` (blocks of the row less 1), ``block``; ``head`` has the row's own values where pos is 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(row.alias("row"), F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("norm"))
    base = base.withColumn("head", F.struct("id", "n_chars", F.sha2("norm", 256).alias("sha"))).withColumn("bytes", F.encode("norm", "utf-8"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("bytes") / BLOCK).cast("int") - 1)
    cut = base.select("row", "head", "bytes", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    block = F.substring("bytes", F.col("pos") * BLOCK + 1, F.lit(BLOCK))
    return cut.select("row", "pos", "last", F.when(F.col("pos") == 0, F.col("head")).alias("head"), block.alias("block"))


def name_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``name`` for ``block``: equal names if and only if equal blocks.

    Every block goes to the naming task of its hash once, with its row; the task sorts its blocks and gives them their
    dense ranks, and (rank, task) is packed into one integer. Hot blocks have a task number of their own.
    """
    rows = rows.withColumn("tag", F.xxhash64("block"))
    counts = stored(rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "counts")
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, math.ceil(n_rows / ROWS_A_TASK))
    hot_tags = [r["tag"] for r in counts.filter((F.col("n") * HOT_SHARE > n_rows) & (F.col("n") > HOT_LEAST)).select("tag").limit(HOT_SHARE).collect()]
    is_hot = F.col("tag").isin(hot_tags) if hot_tags else F.lit(False)
    width = tasks + 1
    task = F.pmod("tag", F.lit(tasks))
    rank = F.dense_rank().over(Window.partitionBy("task").orderBy("block")).cast("long")
    cool = rows.filter(~is_hot).withColumn("task", task).withColumn("name", rank * width + F.col("task")).drop("task", "block", "tag")
    if not hot_tags:
        return cool
    hot = rows.filter(is_hot)
    ranked = hot.select("block").distinct().withColumn("name", F.dense_rank().over(Window.orderBy("block")).cast("long") * width + tasks)
    return cool.unionByName(hot.join(F.broadcast(ranked), "block").drop("block", "tag"))


def name_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` with ``name`` for (``left``, ``right``): distinct pairs are sorted, named and joined back."""
    total = rows.count()
    tasks = max(1, math.ceil(total / ROWS_A_TASK / 10))
    pairs = rows.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")).withColumn("task", F.pmod(F.xxhash64("left", "right"), F.lit(tasks)))
    rank = F.dense_rank().over(Window.partitionBy("task").orderBy("left", "right")).cast("long")
    named = stored(pairs.select("left", "right", "n", (rank * tasks + F.col("task")).alias("name")), "pairs")
    return with_group(rows, named, ["left", "right"], "n", total).drop("left", "right", "n")


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """Per row: ``row``, ``head`` and its identity (``level``, ``name``): the number of pairings and the last name.

    ``row`` names a column that numbers the rows; without it they are numbered here, for use in this result only.
    """
    level, done = 0, []
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    now = stored(name_blocks(_blocks(df, id_col, text_col, number)), "names")
    while True:
        one = F.col("last") == 0
        done.append(now.filter(one).select("row", "head", F.lit(level).alias("level"), "name"))
        more = now.filter(~one)
        if more.isEmpty():
            break
        half = F.col("pos").bitwiseAND(1) == 0
        paired = more.groupBy("row", "last", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(half, F.col("name"))).alias("left"),
            # names are positive; 0 stands for no right half
            F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(0)).alias("right"),
            F.first("head", ignorenulls=True).alias("head"),
        )
        level += 1
        now = stored(name_pairs(paired.withColumn("last", F.shiftright("last", 1))), "names")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _judged(df: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
    rows = identities(df, id_col, text_col, row).select("level", "name", "row", "head.*")
    # of equal texts: most code points, then smallest id, then the row read first
    best = F.min_by(F.struct("id", "row"), F.struct(-F.col("n_chars"), F.col("id").isNull(), "id", "row")).alias("best")
    groups = stored(rows.groupBy("level", "name").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    return with_group(rows, groups, ["level", "name"], "group_size", groups.agg(F.sum("group_size")).first()[0] or 0)


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    rows, row = numbered(df)
    dropped_rows = _judged(rows, id_col, text_col, row).filter(F.col("row") != F.col("best.row")).select(F.col("row").alias(row))
    return rows.join(dropped_rows, row, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the normalised text."""
    return _judged(df, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document and which row of it stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""
