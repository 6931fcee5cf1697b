"""Connected components of a graph of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, freed, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, its component's smallest node, for every node of the links (``a``, ``b``).

    Contraction: in a round every node takes the smallest node next to it, then that one's choice; links are rewritten to
    the choices, and what became a loop or a repetition goes. So links shrink from round to round, the rounds grow with
    the logarithm of the longest path, and all rounds together move a few times the links. Equal choices are combined
    before they are shuffled, so a hub's neighbours cost one row a task. Null nodes are passed over; repeated links and
    loops change nothing but that a node with a loop only is in the result; without links the result is empty.
    """
    spark = links.sparkSession
    proper = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    now = stored(proper.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up"))
        up = stored(up, "choices")
        jumped = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", F.col("upper").alias("up"))
        jumped = stored(jumped, "choices")
        if found is None:
            found = jumped.select("node", F.col("up").alias("comp"))
        else:
            old = found
            moved = old.join(jumped.select(F.col("node").alias("comp"), "up"), "comp", "left")
            found = stored(moved.select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        at = lambda x: jumped.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up"))
        new = now.filter("a <> b").join(at("a"), "a").join(at("b"), "b").filter("a_up <> b_up")
        new = stored(new.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
        dropped(now)
        dropped(up)
        freed(spark)
        if new.isEmpty():
            return found
        now = new
