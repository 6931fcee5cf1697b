"""PageRank, call traversal and change impact as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_test_path
from ..options import DEFAULTS, Options
from ..runtime import discard, release, stored

#: Rounds that one job runs before the state is stored and the convergence looked at. Each round reads the one before
#: three times, so chained plans triple; one round a job was fastest.
ROUNDS_A_JOB = 1


def pagerank(nodes: DataFrame, edges: DataFrame, *, inflow: DataFrame | None = None, n_refs: float = 1.0, damping: float = DEFAULTS.damping, rounds: int = DEFAULTS.max_rounds, tolerance: float | None = DEFAULTS.tolerance) -> DataFrame:
    """``id`` and ``score`` for ``nodes`` (``id``, ``weight`` of the teleport), ``edges`` (``src``, ``dst``, ``weight``).

    Edges are normalised by source; dangling mass returns by the teleport; outside ``inflow`` (``id``, ``weight``) adds
    damping * weight / n_refs each round and is not normalised, so scores may add up to more than 1. Only nodes with an edge
    or inflow are iterated; all others share one factor of their teleport, which rides along as a column. A job chains a few
    rounds lazily and keeps each round's score, so that the first round under the tolerance is the one returned.
    """
    spark = nodes.sparkSession
    total = nodes.agg(F.sum("weight").alias("total"))
    nodes = nodes.crossJoin(F.broadcast(total)).select("id", (F.col("weight") / F.col("total")).alias("p"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    trans = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("t")), "transitions")
    ends = trans.select(F.col("src").alias("id"), F.lit(True).alias("has_out")).union(trans.select(F.col("dst"), F.lit(False)))
    extra = inflow.groupBy("id").agg(F.sum("weight").alias("ext")) if inflow is not None else spark.createDataFrame([], f"id {dict(nodes.dtypes)['id']}, ext double")
    ends = ends.union(extra.select("id", F.lit(False)))
    active = ends.groupBy("id").agg(F.max("has_out").alias("has_out"))
    base = nodes.join(active, "id").join(extra, "id", "left").withColumn("ext", F.coalesce("ext", F.lit(0.0)) / F.lit(float(n_refs)))
    idle = nodes.join(active, "id", "left_anti")
    idle_mass = F.broadcast(idle.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("idle")))
    state = stored(base.crossJoin(idle_mass).withColumn("s", F.col("p")).withColumn("f", F.lit(1.0)), "rank")
    if state.isEmpty():
        return nodes.select("id", F.col("p").alias("score"))

    def spread(now: DataFrame) -> DataFrame:
        came = trans.join(now.select(F.col("id").alias("src"), "s"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("s") * F.col("t")).alias("came"))
        return now.join(came, "id", "left")

    state = iterate(state, spread, damping=damping, rounds=rounds, tolerance=tolerance)
    factor = F.broadcast(state.agg(F.max("f").alias("f")))
    return state.select("id", F.col("s").alias("score")).unionByName(idle.crossJoin(factor).select("id", (F.col("f") * F.col("p")).alias("score")))


def iterate(state: DataFrame, spread, *, damping: float, rounds: int, tolerance: float | None) -> DataFrame:
    """(``id``, ``p``, ``s``, ``f``) after the rounds or under the tolerance, from a stored ``state`` with ``has_out``, ``ext`` and ``idle`` beside them.

    ``spread`` gives the state with ``came``, what each row gets by the edges, or null. A state goes when the next one is stored.
    """
    done = 0
    held = state
    while done < rounds:
        chunk = min(ROUNDS_A_JOB, rounds - done)
        now = state.withColumn("h0", F.col("s")).withColumn("f0", F.col("f"))
        for k in range(chunk):
            mass = now.agg((F.coalesce(F.sum(F.when(~F.col("has_out"), F.col("s"))), F.lit(0.0)) + F.max("f") * F.max("idle")).alias("mass"))
            now = spread(now).crossJoin(F.broadcast(mass))
            factor = F.lit(1 - damping) + F.lit(damping) * F.col("mass")
            now = now.withColumn("f", factor).withColumn("s", factor * F.col("p") + F.lit(damping) * (F.coalesce("came", F.lit(0.0)) + F.col("ext"))).drop("mass", "came")
            now = now.withColumn(f"h{k + 1}", F.col("s")).withColumn(f"f{k + 1}", F.col("f"))
        now = stored(now, "rank")
        discard(held)
        held = now
        done += chunk
        if done % 4 == 0:
            release(now.sparkSession)
        stop = chunk if done >= rounds else None
        if tolerance is not None:
            moved = [(F.sum(F.abs(F.col(f"h{k + 1}") - F.col(f"h{k}"))) + F.max(F.abs(F.col(f"f{k + 1}") - F.col(f"f{k}")) * F.col("idle"))).alias(f"d{k}") for k in range(chunk)]
            deltas = now.agg(*moved).first()
            stop = next((k + 1 for k in range(chunk) if deltas[k] < tolerance), stop)
        if stop is not None:
            return now.select("id", "p", F.col(f"h{stop}").alias("s"), F.col(f"f{stop}").alias("f"))
        state = now.drop(*(f"{x}{k}" for x in "hf" for k in range(chunk + 1)))
    return state


def teleport(symbols: DataFrame, focus_names: list[str] = (), focus_files: list[str] = (), o: Options = DEFAULTS) -> DataFrame:
    """``symbols`` with ``weight``: 1, and a boost for each of a name and a file in focus."""
    weight = F.lit(1.0)
    if focus_names:
        weight = weight + F.when(F.col("name").isin(list(focus_names)), F.lit(o.focus_boost)).otherwise(F.lit(0.0))
    if focus_files:
        weight = weight + F.when(F.col("path").isin(list(focus_files)), F.lit(o.focus_boost)).otherwise(F.lit(0.0))
    return symbols.withColumn("weight", weight)


def walkable(refs: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and symbols as every hop reads them: slim, distinct and stored."""
    r = refs.select("src_path", "src_line", "symbol_name", "def_path", (F.col("confidence") == "high").alias("edge_high")).distinct()
    return stored(r, "refs"), stored(symbols.select("name", "path", "line", "end_line"), "symbols")


def traverse(refs: DataFrame, symbols: DataFrame, seed: DataFrame, direction: str = "up", max_hops: int = DEFAULTS.max_hops) -> DataFrame:
    """(``name``, ``path``, ``line``, ``depth``, ``confidence``) reached from the ``seed`` (``name``, ``path``) symbols.

    Upwards every symbol whose body holds the referring line is a caller (all enclosing ones); downwards callees match by path
    and name. Only a step to the same name and path is left out, so in a cycle the seed comes back. A node is high if one path
    of high edges reaches it. The loop keeps distinct frontiers and stops when one is empty. ``refs`` and ``symbols`` may be a result
    of ``walkable``; otherwise that is made first.
    """
    if direction not in ("up", "down"):
        raise ValueError(f"unknown direction: {direction}")
    cols = ["name", "path", "line", "end_line", "high"]
    r, sym = (refs, symbols) if "edge_high" in refs.columns else walkable(refs, symbols)
    frontier = stored(sym.join(seed.select("name", "path").distinct(), ["name", "path"]).withColumn("high", F.lit(True)).select(*cols).distinct(), "frontier")
    levels: list[DataFrame] = []
    for depth in range(1, max_hops + 1):
        c = frontier.select(*(F.col(x).alias(f"c_{x}") for x in cols))
        if direction == "up":
            hop = c.join(r, (F.col("c_name") == F.col("symbol_name")) & (F.col("c_path") == F.col("def_path")))
            nxt = hop.join(sym, (F.col("src_path") == F.col("path")) & F.col("src_line").between(F.col("line"), F.col("end_line")))
        else:
            hop = c.join(r, (F.col("c_path") == F.col("src_path")) & F.col("src_line").between(F.col("c_line"), F.col("c_end_line")))
            nxt = hop.join(sym, (F.col("def_path") == F.col("path")) & (F.col("symbol_name") == F.col("name")))
        nxt = nxt.filter(~((F.col("name") == F.col("c_name")) & (F.col("path") == F.col("c_path"))))
        # a high path to a row makes a low one needless
        nxt = nxt.groupBy("name", "path", "line", "end_line").agg(F.max(F.col("c_high") & F.col("edge_high")).alias("high"))
        frontier = stored(nxt, "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    if not levels:
        return frontier.select("name", "path", "line", F.lit(0).alias("depth"), F.lit("high").alias("confidence")).limit(0)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    rolled = every.groupBy("name", "path").agg(F.min("line").alias("line"), F.min("depth").alias("depth"), F.max("high").alias("high"))
    return rolled.select("name", "path", "line", "depth", F.when(F.col("high"), "high").otherwise("low").alias("confidence"))


def hierarchy(refs: DataFrame, symbols: DataFrame, seed: DataFrame, direction: str = "both", max_hops: int = DEFAULTS.max_hops) -> DataFrame:
    """Callers and callees with a ``direction`` column."""
    if direction not in ("up", "down", "both"):
        raise ValueError(f"unknown direction: {direction}")
    if "edge_high" not in refs.columns:
        refs, symbols = walkable(refs, symbols)
    parts = [traverse(refs, symbols, seed, d, max_hops).withColumn("direction", F.lit(d)) for d in (("up", "down") if direction == "both" else (direction,))]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def display_order(rows: DataFrame) -> DataFrame:
    """Callers and callees as they are shown: high ones first, then by depth and name."""
    return rows.orderBy(F.col("confidence") != "high", "depth", "name", "path")


def impact(callers: DataFrame, important: DataFrame | None = None, entry=None, test=None) -> DataFrame:
    """``callers`` with ``bucket`` (test, entrypoint, prod, uncertain), ``direct`` and ``important``."""
    test = test if test is not None else is_test_path("path")
    entry = entry if entry is not None else F.lit(False)
    bucket = F.when(F.col("confidence") != "high", "uncertain").when(test, "test").when(entry, "entrypoint").otherwise("prod")
    rows = callers.withColumn("bucket", bucket).withColumn("direct", F.col("depth") == 1)
    if important is None:
        return rows.withColumn("important", F.lit(False))
    # the thirty names of most score
    best = important.groupBy("name").agg(F.max("score").alias("score")) if "score" in important.columns else important.select("name", F.lit(0.0).alias("score")).distinct()
    names = best.orderBy(F.desc("score"), "name").limit(30).select("name", F.lit(True).alias("important"))
    return rows.join(F.broadcast(names), "name", "left").withColumn("important", F.coalesce("important", F.lit(False)))


def impact_summary(rows: DataFrame) -> DataFrame:
    count = lambda test, name: F.count_if(test).alias(name)
    sure = F.col("bucket") != "uncertain"
    return rows.agg(
        count(sure & F.col("direct"), "direct"), count(sure & ~F.col("direct"), "transitive"), count(F.col("bucket") == "test", "test"), count(F.col("bucket") == "entrypoint", "entrypoint"),
        count(F.col("bucket") == "prod", "prod"), count(~sure, "uncertain"), count(F.col("important") & sure, "important"), F.countDistinct(F.when(sure, F.col("path"))).alias("files"),
    )
