"""Duplicate detection: winnowed fingerprints, exact and renamed groups, near pairs, call patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from ..options import DEFAULTS, Options
from ..runtime import stored_buckets


def _held(df: DataFrame, name: str, value: Column, keep: tuple[str, ...]) -> DataFrame:
    """``value`` as a column of its own, computed once a row: an expression inside a lambda would be evaluated for each element.

    Generating one row from an array of one keeps the optimizer from pulling the expression into the lambda again.
    """
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def fingerprint_index(units: DataFrame, tokens: Column | str = "tokens", keys: tuple[str, ...] = ("path", "line"), o: Options = DEFAULTS, *, joiner: str = " ", digest=hash32) -> DataFrame:
    """(keys, ``fp_value``), distinct within a unit: winnowed hashes of the unit's tokens, made inside its row without a shuffle.

    Fewer tokens than ``winnow_k`` give one hash of all, fewer grams than ``winnow_w`` their minimum, else the minimum of
    every full window; no tokens give no row.
    """
    k, w = o.winnow_k, o.winnow_w
    full = lambda n, width: F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1))
    rows = _held(units, "_t", F.col(tokens) if isinstance(tokens, str) else tokens, keys).filter(F.size("_t") > 0)
    grams = F.transform(full(F.size("_t"), k), lambda i: digest(F.array_join(F.slice("_t", i, k), joiner)))
    rows = _held(rows, "_g", grams, keys)
    minima = F.transform(full(F.size("_g"), w), lambda i: F.array_min(F.slice("_g", i, w)))
    return rows.select(*keys, F.explode(F.array_distinct(minima)).alias("fp_value"))


def flood(index: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Values in more units than the cap: boilerplate that would make every pair a candidate."""
    return index.groupBy("fp_value").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > o.flood_df)


def dealt(index: DataFrame, key: str = "unit", o: Options = DEFAULTS) -> DataFrame:
    """(``key``, ``fp_value``, ``df``): the distinct rows without flood values, stored by value as ``near_pairs`` reads them.

    The only shuffle of the whole index: repeated rows and flood values go in its stage, and joins by value need none.
    """
    df = F.count(F.lit(1)).over(Window.partitionBy("fp_value"))
    return stored_buckets(index.select(key, "fp_value"), "fp_value", "index", lambda rows: rows.distinct().withColumn("df", df).filter(F.col("df") <= o.flood_df))


def near_pairs(index: DataFrame, units: DataFrame, key: str = "unit", shape: str = "shape_hash", o: Options = DEFAULTS, *, scope: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """(``a``, ``b``, ``shared``, ``similarity``) with a < b: enough shared values, Jaccard at the threshold, other shapes.

    Flood values go before the self-join, so a value meets ``flood_df`` units at most and joined rows stay in proportion to
    the index. ``scope`` (``key``) keeps pairs with a member in it; with ``compat`` the sets are cut to the scope's values
    as a narrow scan would see them, which inflates the similarity; by default both sets are whole. ``index`` may be ``dealt``.
    """
    kept = index if "df" in index.columns else dealt(index, key, o)
    seeds = None
    if scope is not None:
        seeds = kept.join(scope.select(key), key, "left_semi")
        values = seeds.select("fp_value").distinct()
        candidates = kept.join(values, "fp_value", "left_semi")
    else:
        candidates = kept
    # with compat the scope's own sets are whole, the others' are what shares a value with them
    sized = candidates if compat and scope is not None else kept
    sizes = sized.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # a value of one unit makes no pair
    left = (seeds if seeds is not None else candidates).filter("df > 1").select(F.col(key).alias("l"), "fp_value")
    right = candidates.filter("df > 1").select(F.col(key).alias("r"), "fp_value")
    pairs = left.join(right, "fp_value").filter("l < r" if scope is None else "l <> r")
    pairs = pairs.groupBy("l", "r").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= o.min_shared)
    if scope is not None:
        pairs = pairs.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), "shared").distinct()
    side = lambda x, n: sizes.select(F.col(key).alias(x), F.col("n").alias(n))
    meta = lambda x, n: units.select(F.col(key).alias(x), F.col(shape).alias(n))
    full = pairs.join(side("l", "nl"), "l").join(side("r", "nr"), "r")
    jaccard = F.col("shared") / (F.col("nl") + F.col("nr") - F.col("shared"))
    full = full.withColumn("jaccard", jaccard).filter(F.col("jaccard") >= o.min_similarity)
    full = full.join(meta("l", "hl"), "l").join(meta("r", "hr"), "r").filter("hl <> hr")
    return full.select(F.col("l").alias("a"), F.col("r").alias("b"), "shared", F.round("jaccard", 3).alias("similarity"))


def significant(fingerprints: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    return fingerprints.filter(F.col("has_control_flow") & (F.col("node_count") >= o.min_nodes))


_MEMBER = ("path", "line", "name", "kind")


def shape_groups(fingerprints: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """(``verdict``, ``shape_hash``, ``raw_token_hash``, ``size``, ``members``): EXACT_DUP by shape and raw tokens; RENAMED_DUP over one member of each raw cluster of a shape."""
    sig = significant(fingerprints, o)
    member = F.struct(*_MEMBER)
    clusters = sig.groupBy("shape_hash", "raw_token_hash").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(member)).alias("members"))
    exact = clusters.filter("size >= 2").select(F.lit("EXACT_DUP").alias("verdict"), "shape_hash", "raw_token_hash", "size", "members")
    reps = clusters.select("shape_hash", F.element_at("members", 1).alias("rep"))
    renamed = reps.groupBy("shape_hash").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("rep")).alias("members")).filter("size >= 2")
    return exact.unionByName(renamed.select(F.lit("RENAMED_DUP").alias("verdict"), "shape_hash", F.lit(None).cast("string").alias("raw_token_hash"), "size", "members"))


def suppressed_shapes(fingerprints: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Shapes of two members or more of which fewer than two pass the gate."""
    gate = F.col("has_control_flow") & (F.col("node_count") >= o.min_nodes)
    return fingerprints.groupBy("shape_hash").agg(F.count(F.lit(1)).alias("size"), F.count_if(gate).alias("passing")).filter("size >= 2 AND passing < 2")


def call_patterns(fingerprints: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Units of one call multiset and at least two shapes."""
    sig = significant(fingerprints, o).filter(F.col("call_hash").isNotNull())
    grouped = sig.groupBy("call_hash").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("shape_hash").alias("shapes"), F.array_sort(F.collect_list(F.struct(*_MEMBER))).alias("members"))
    return grouped.filter("size >= 2 AND shapes >= 2")


def duplicates(fingerprints: DataFrame, index: DataFrame, o: Options = DEFAULTS, *, scope_file: str | None = None, near_global: bool = False, call_pattern: bool = False, compat: bool = False) -> DataFrame:
    """All groups: (``verdict``, ``size``, ``similarity``, ``members``). Detection is global; a scope only filters what is returned."""
    groups = shape_groups(fingerprints, o).select("verdict", "size", F.when(F.col("verdict") == "EXACT_DUP", F.lit(1.0)).alias("similarity"), "members")
    if scope_file or near_global:
        unit = F.concat_ws("\x1f", "path", F.col("line").cast("string"))
        idx = index.select(unit.alias("unit"), "fp_value")
        units = fingerprints.select(unit.alias("unit"), "shape_hash", F.struct(*_MEMBER).alias("m"), "path")
        scope = units.filter(F.col("path") == scope_file).select("unit") if scope_file else None
        pairs = near_pairs(idx, units, "unit", "shape_hash", o, scope=scope, compat=compat)
        taken = shape_groups(fingerprints, o).select(F.explode("members").alias("m")).select(F.concat_ws("\x1f", "m.path", F.col("m.line").cast("string")).alias("unit")).distinct().withColumn("in1", F.lit(True))
        side = lambda x: units.select(F.col("unit").alias(x), F.col("m").alias(f"m{x}")).join(taken.withColumnRenamed("unit", x).withColumnRenamed("in1", f"in_{x}"), x, "left")
        joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(~(F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False))))
        groups = groups.unionByName(joined.select(F.lit("NEAR_DUP").alias("verdict"), F.lit(2).cast("long").alias("size"), "similarity", F.array_sort(F.array("ma", "mb")).alias("members")))
    if call_pattern:
        groups = groups.unionByName(call_patterns(fingerprints, o).select(F.lit("CALL_PATTERN").alias("verdict"), "size", F.lit(None).cast("double").alias("similarity"), "members"))
    if scope_file:
        groups = groups.filter(F.exists("members", lambda m: m["path"] == scope_file))
    return groups


def clone_pairs(rows: DataFrame, key: str, shape: str) -> DataFrame:
    """(``first``, ``other``): a star from the smallest key to the others of a shape; the smallest comes by an aggregation, not a window."""
    head = rows.groupBy(shape).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(head, shape).filter(F.col(key) != F.col("first")).select("first", F.col(key).alias("other"))
