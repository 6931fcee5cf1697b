"""Retention of cached groups: reasons, and least-recently-used order down to a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import DEFAULTS, Options


def running_total(df: DataFrame, value: str, order: list[str], bucket) -> DataFrame:
    """``df`` with ``running``, the total of ``value`` up to the row in the order.

    ``bucket`` is a column whose order agrees with ``order``'s: sums of earlier buckets are added to sums inside one, so only
    bucket totals meet in one task.
    """
    keyed = df.withColumn("_bucket", bucket)
    sums = keyed.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("_in", F.sum(value).over(inside)).join(offsets, "_bucket").withColumn("running", F.col("_before") + F.col("_in")).drop("_bucket", "_in", "_before")


def evictions(usage: DataFrame, quota: int, ratio: float, *, bucket) -> DataFrame:
    """``usage`` (``key``, ``last_access``, ``bytes``) with ``evict``: over the quota, the oldest go until ratio * quota is left."""
    total = F.broadcast(usage.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")))
    rows = running_total(usage, "bytes", ["last_access", "key"], bucket).crossJoin(total)
    target = F.lit(int(quota * ratio))
    over = F.col("total") > F.lit(quota)
    # what is left before this row goes is still over the target
    left = F.col("total") - (F.col("running") - F.col("bytes"))
    return rows.withColumn("evict", over & (left > target)).drop("total")


def prune_reason(now: Column, o: Options = DEFAULTS) -> Column:
    """Why a cached group (``path_exists``, ``last_access`` timestamp) goes whatever the quota: ``missing`` or ``idle``; null if it stays."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_access")
    return F.when(~F.col("path_exists") & (age > o.missing_days * 86_400), "missing").when(age > o.idle_days * 86_400, "idle")


def idle(states: DataFrame, now: Column, o: Options = DEFAULTS) -> DataFrame:
    """States (``last_access`` timestamp, ``busy``) that nobody has used for the time to live; a busy one is never idle."""
    return states.filter(~F.coalesce("busy", F.lit(False)) & (F.unix_timestamp(now) - F.unix_timestamp("last_access") > o.idle_ttl_s))


def aged_order(waiting: DataFrame, now: Column, ageing_s: int, most: int) -> DataFrame:
    """Waiting calls (``priority``, ``since`` timestamp, ``ticket``) as they are served: priority grows with the wait up to ``most``; then by ticket."""
    waited = F.floor((F.unix_timestamp(now) - F.unix_timestamp("since")) / ageing_s)
    return waiting.withColumn("effective", F.least(F.col("priority") + F.greatest(waited, F.lit(0)), F.greatest(F.col("priority"), F.lit(most)))).orderBy(F.desc("effective"), "ticket")
