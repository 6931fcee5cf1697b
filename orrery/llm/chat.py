"""Chat formatting after a collapse of cumulative snapshots, in DataFrame functions only.

Chat logs often hold one row set for every state of a conversation: each state is a prefix of the next. Every turn gets a
hash of its place and content; the sums of these hashes over the first k turns are the conversation's rolling prefix
hashes, in four lanes of 32 bits. Sums can be built from parts, so a huge conversation is summed in blocks of turns, by
many tasks. A conversation whose whole hash is a proper prefix hash of another is dropped by an anti-join; of equal
conversations the smallest id stays. What remains is rendered turn by turn and joined in parts of ``BLOCK`` turns.

Defined results. A null role or text counts as empty; a null id is one conversation of its own; null turn numbers come
first. Turns with one number are ordered by role and text, and rows repeated whole count once. Empty tables give empty
results; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stored, table, with_group

#: Turn numbers of a block: a window or a rendered part never holds more of them.
BLOCK = 256
LANES = ("a", "b", "c", "d")
#: How a turn is rendered.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _lane(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``place`` (from 1), ``block`` and the rolling prefix hashes ``a`` to ``d``."""
    clean = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    clean = clean.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = stored(clean.withColumn("rank", F.row_number().over(inside)), "turns")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(sums: DataFrame, names: list[str]) -> DataFrame:
        return sums.select("conv", "block", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}0") for n in names))

    def with_earlier(rows: DataFrame, sums: DataFrame, names: list[str]) -> DataFrame:
        # a block has BLOCK turn numbers, so no key of this join is hot but by turns of one number
        s = earlier(sums, names).withColumnsRenamed({"conv": "conv_", "block": "block_"})
        return rows.join(s, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))).drop("conv_", "block_")

    placed = with_earlier(ranked, ranked.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n")), ["n"])
    placed = placed.withColumn("place", F.col("n0") + F.col("rank")).drop("n0")
    # lengths stand before the parts, so that no two turns give one string
    content = F.concat_ws(":", F.col("place").cast("string"), F.char_length("role").cast("string"), "role", "text")
    digest = F.md5(content)
    hashed = placed.withColumn("digest", digest).withColumns({x: _lane(F.col("digest"), i) for i, x in enumerate(LANES)}).drop("digest")
    sums = hashed.groupBy("conv", "block").agg(*(F.sum(x).alias(x) for x in LANES))
    running = Window.partitionBy("conv", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({x: F.sum(x).over(running) for x in LANES})
    rolled = with_earlier(rolled, sums, list(LANES))
    return rolled.withColumns({x: F.col(x) + F.col(f"{x}0") for x in LANES}).drop(*(f"{x}0" for x in LANES))


def collapse(turns: DataFrame) -> DataFrame:
    """The turns of the maximal conversations: ``conv``, ``place``, ``block``, ``role``, ``text`` and ``n_copies`` of the whole conversation."""
    rolled = stored(numbered(turns), "prefixes")
    # places are gapless: the last one is the number of turns
    lengths = stored(rolled.groupBy("conv").agg(F.max("place").alias("n_turns")), "lengths")
    total = lengths.agg(F.sum("n_turns")).first()[0] or 0
    joined = with_group(rolled.select("conv", "place", *LANES), lengths, ["conv"], "n_turns", total)
    whole = joined.filter(F.col("place") == F.col("n_turns")).groupBy("place", *LANES).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    proper = joined.filter(F.col("place") < F.col("n_turns")).select("place", *LANES).distinct()
    kept = stored(whole.join(proper, ["place", *LANES], "left_anti").select("conv", F.col("place").alias("n_turns"), "n_copies"), "maximal")
    return with_group(rolled, kept, ["conv"], "n_turns", total).select("conv", "place", "block", "role", "text", "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``part`` (from 0), ``n_turns``, ``n_copies`` and ``rendered``: the parts of a conversation in order are its text."""
    head, middle, tail = TEMPLATE
    line = F.concat(F.lit(head), "role", F.lit(middle), "text", F.lit(tail))
    parts = turns.withColumn("part", F.floor((F.col("place") - 1) / BLOCK)).groupBy("conv", "part")
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return parts.agg(F.count(F.lit(1)).alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered")).withColumnRenamed("conv", "conv_id")


def op1_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return render(collapse(table(spark, sf_dir, "conversations")))


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role, text
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
), p AS (
  SELECT conv_id, place, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, ';' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place)) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t
), w AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n_turns
  AND prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns) GROUP BY prefix
)
SELECT t.conv_id, (t.place - 1) // {BLOCK} AS part, count(*) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id
GROUP BY 1, 2
"""
