"""A budget of rows dealt over sections: floors first, then a highest-averages apportionment.

The k-th row that a section claims beyond its floor has the price k / (priority * rows it lacks). The cheapest claims are met
until the budget is used up, so equal priorities lose equal shares of what they lack, and doubling a priority doubles a
section's pace. No claim depends on another one: the whole deal is one ordering of claims with a limit.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import positions


@dataclass(frozen=True)
class Section:
    name: str
    size: int
    priority: int = 1
    min_keep: int = 0


def allocate(sections: Sequence[Section], budget: int, *, full: bool = False) -> dict[str, int]:
    """Rows shown of each section, for a few sections at hand; ``allotted`` is the same over a table of them."""
    if full:
        return {s.name: s.size for s in sections}
    floors = [min(s.min_keep, s.size) for s in sections]
    shown = {s.name: f for s, f in zip(sections, floors, strict=True)}
    claims = (
        (k / (s.priority * (s.size - f)) if s.priority > 0 else float("inf"), -s.priority, s.name, k)
        for s, f in zip(sections, floors, strict=True)
        for k in range(1, min(s.size - f, max(0, budget)) + 1)
    )
    for *_, name, _ in heapq.nsmallest(max(0, budget - sum(floors)), claims):
        shown[name] += 1
    return shown


def allotted(sections: DataFrame, budget: int, *, full: bool = False) -> DataFrame:
    """``sections`` (``name``, ``size``, ``priority``, ``min_keep``) with ``shown`` and ``elided``.

    Defined results. Null priorities count 1, null floors 0, null sizes no rows. A floor may exceed the budget. An empty table gives
    an empty one. A section makes ``budget`` claims at most, and only the cheapest ``budget`` of all are ever kept together.
    """
    clean = sections.select("name", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("priority", F.lit(1)).cast("double").alias("priority"), F.coalesce("min_keep", F.lit(0)).cast("long").alias("min_keep"))
    if full:
        return clean.select("name", "size", F.col("size").alias("shown"), F.lit(0).cast("long").alias("elided"))
    floor = F.greatest(F.lit(0), F.least("min_keep", "size"))
    clean = clean.select("name", "size", "priority", floor.alias("floor"), (F.col("size") - floor).alias("lacks"))
    rest = max(0, budget - (clean.agg(F.sum("floor")).first()[0] or 0))
    price = F.when(F.col("priority") > 0, F.col("k") / (F.col("priority") * F.col("lacks"))).otherwise(F.lit(float("inf")))
    claims = clean.filter("lacks > 0").select("name", "priority", "lacks", F.explode(F.sequence(F.lit(1).cast("long"), F.least("lacks", F.lit(max(1, budget)).cast("long")))).alias("k"))
    met = claims.orderBy(price, F.desc("priority"), "name", "k").limit(rest).groupBy("name").agg(F.count(F.lit(1)).alias("more"))
    out = clean.join(met, "name", "left").withColumn("shown", F.col("floor") + F.coalesce("more", F.lit(0)))
    return out.select("name", "size", "shown", (F.col("size") - F.col("shown")).alias("elided"))


def take_sections(rows: DataFrame, by: str, order: list[str], shown: DataFrame) -> DataFrame:
    """The first allotted rows of each section; ``shown`` is a result of ``allotted``.

    Sections that show nothing are dropped before the ranking; a rank limit beside the window lets the planner keep only
    the first rows of a section in each task.
    """
    table = shown.filter("shown > 0").select(F.col("name").alias("_name"), F.col("shown").alias("_shown"))
    most = table.agg(F.max("_shown")).first()[0] or 0
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rank") <= most)
    return ranked.join(table, F.col(by) == F.col("_name")).filter("_rank <= _shown").drop("_name", "_rank", "_shown")


__all__ = ["Section", "allocate", "allotted", "positions", "take_sections"]
