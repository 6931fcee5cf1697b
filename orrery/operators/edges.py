"""Tokens, name-level reference edges, usage and interval mapping of lines to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import IDENTIFIER, confidence_weight, quality
from ..options import DEFAULTS, Options
from ..runtime import stored


#: So many hashes are broadcast at most (8 bytes each, about 64 MB as a table); beyond, as many words of 64 bits that stand for all keys.
MOST_HASHES = 2_000_000


def tokens(lines: DataFrame, *, lower: bool = False, apart: bool = False) -> DataFrame:
    """(``path``, ``line``, ``name``, ``mult``): identifiers of each line and how often it has them.

    With ``apart`` no two rows of ``lines`` share path and line: then a row's sorted names are counted by their runs inside it, and
    nothing is shuffled. Otherwise rows of one line are added up.
    """
    text = F.lower("txt") if lower else F.col("txt")
    found = F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))
    if not apart:
        return lines.select("path", "line", F.explode(found).alias("name")).groupBy("path", "line", "name").agg(F.count(F.lit(1)).alias("mult"))
    others = [c for c in lines.columns if c != "txt"]
    # each array is held by a generator of one row, else a lambda would make it again for each element
    rows = lines.select(*others, F.explode(F.array(F.sort_array(found))).alias("_t")).filter(F.size("_t") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    rows = rows.select(*others, "_t", F.explode(F.array(first)).alias("_s"))
    rows = rows.select(*others, "_t", "_s", F.posexplode("_s").alias("_k", "_at"))
    mult = F.coalesce(F.get("_s", F.col("_k") + 1), F.size("_t")) - F.col("_at")
    return rows.select(*others, F.get("_t", F.col("_at")).alias("name"), mult.cast("long").alias("mult"))


def known(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` less most that meet no row of ``keys`` in its columns: by a broadcast of 64-bit hashes, before they are shuffled.

    A join on the columns must follow. More than ``MOST_HASHES`` keys are put into as many words, a Bloom filter: a key sets four bits of
    its word. So the broadcast stays as it is, and of rows without a key about 1 in 100 pass at five keys a word, half at thirty.
    """
    by = F.xxhash64(*keys.columns)
    hashes = stored(keys.select(by.alias("_h")).distinct(), "hashes")
    if hashes.count() <= MOST_HASHES:
        return rows.withColumn("_h", by).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
    if not MOST_HASHES:
        return rows
    word = lambda h: F.pmod(h, F.lit(MOST_HASHES).cast("long"))
    bit = lambda h, at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int"))
    bits = lambda h: bit(h, 40).bitwiseOR(bit(h, 46)).bitwiseOR(bit(h, 52)).bitwiseOR(bit(h, 58))
    words = stored(hashes.groupBy(word(F.col("_h")).alias("_word")).agg(F.bit_or(bits(F.col("_h"))).alias("_bits")), "words")
    held = (word(by) == F.col("_word")) & (bits(by).bitwiseAND(F.bitwise_not("_bits")) == 0)
    return rows.join(F.broadcast(words), held, "left_semi")


def definition_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("defs"), F.countDistinct("path").alias("files"))


def fanout_names(symbols: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Names with more definitions than the fan-out cap."""
    return definition_counts(symbols).filter(F.col("defs") > o.max_fanout).select("name", "defs")


def narrow_definitions(symbols: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Definitions of names within the fan-out cap if there is one, with ``defs``."""
    counts = definition_counts(symbols).select("name", "defs")
    if o.max_fanout is not None:
        counts = counts.filter(F.col("defs") <= o.max_fanout)
    return symbols.join(counts, "name")


def _bodies(symbols: DataFrame, o: Options) -> DataFrame:
    """Narrow definitions by (``name``, ``path``, ``line``) with the end of the smallest body that starts there.

    Of definitions that share their start, a line outside the smallest body is outside one of them, and only then an edge.
    """
    return narrow_definitions(symbols, o).groupBy("name", F.col("path").alias("def_path"), F.col("line").alias("def_line")).agg(F.min("end_line").alias("def_end"))


def name_edges(token_rows: DataFrame, symbols: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Edges from lines to all definitions of the names on them, but for a definition's own body.

    The fan-out cap is applied to the definitions before the join, which bounds the rows that one token can make; both sides of the
    join are distinct, so its rows are the edges and nothing is shuffled after it.
    """
    inside = (F.col("path") == F.col("def_path")) & F.col("line").between(F.col("def_line"), F.col("def_end"))
    bodies = _bodies(symbols, o)
    joined = known(token_rows, bodies.select("name")).join(bodies, "name").filter(~inside)
    edges = joined.select(F.col("path").alias("src_path"), F.col("line").alias("src_line"), F.col("name").alias("symbol_name"), "def_path", "def_line", F.col("mult").alias("multiplicity"), F.lit("low").alias("confidence"))
    if o.edge_budget is not None:
        edges = edges.orderBy("src_path", "src_line", "symbol_name", "def_path", "def_line").limit(o.edge_budget)
    return edges


def budget_reached(edges: DataFrame, o: Options = DEFAULTS) -> bool:
    """Whether the edge budget cut the edges off."""
    return o.edge_budget is not None and edges.count() >= o.edge_budget


def adaptive_file_cap(n_symbols: int, o: Options = DEFAULTS) -> int:
    """Files that a fixed amount of work allows: fewer the more symbols there are, within bounds."""
    return max(o.least_files, min(o.file_cap, o.work_budget // max(1, n_symbols)))


def external_usage(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Occurrences outside its own body for every definition, 0 included."""
    used = edges.groupBy(F.col("def_path").alias("path"), F.col("def_line").alias("line"), F.col("symbol_name").alias("name")).agg(F.sum("multiplicity").alias("usage"))
    defs = symbols.select("path", "line", "name").distinct()
    return defs.join(used, ["path", "line", "name"], "left").select("path", "line", "name", F.coalesce("usage", F.lit(0)).cast("long").alias("usage"))


def direct_usage(token_rows: DataFrame, symbols: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """``external_usage`` without the edges between: own-body tokens are taken off the total of each name.

    Usage of a definition is the name's total over the corpus less the tokens in its own body; so tokens are combined by
    name and by (name, path) before they meet the definitions, and no edge is ever made.
    """
    defs = stored(_bodies(symbols, o).withColumnsRenamed({"def_path": "path", "def_line": "line", "def_end": "end_line"}), "bodies")
    by_name = known(token_rows, defs.select("name")).groupBy("name").agg(F.sum("mult").alias("total"))
    own = known(token_rows, defs.select("name", "path")).withColumnRenamed("line", "at")
    inside = defs.join(own, ["name", "path"]).filter(F.col("at").between(F.col("line"), F.col("end_line")))
    hidden = inside.groupBy("name", "path", "line").agg(F.sum("mult").alias("own"))
    keys = defs.select("name", "path", "line")
    narrow = keys.join(by_name, "name", "left").join(hidden, ["name", "path", "line"], "left").select("path", "line", "name", (F.coalesce("total", F.lit(0)) - F.coalesce("own", F.lit(0))).cast("long").alias("usage"))
    wide = symbols.select("path", "line", "name").distinct().join(narrow.select("path", "line", "name"), ["path", "line", "name"], "left_anti").withColumn("usage", F.lit(0).cast("long"))
    return narrow.unionByName(wide)


def unwired(symbols: DataFrame, usage: DataFrame, o: Options = DEFAULTS, exempt: DataFrame | None = None) -> DataFrame:
    """Top-level definitions nobody names, and those whose name is too common to tell."""
    counts = definition_counts(symbols).select("name", "defs")
    top = symbols.filter((F.col("scope") == "") & F.col("kind").isin(*o.referenceable) & ~F.col("name").rlike("^__.*__$"))
    if exempt is not None:
        top = top.join(exempt, ["path", "line"], "left_anti")
    rows = top.join(counts, "name").join(usage, ["path", "line", "name"])
    verdict = F.when(F.col("defs") > o.max_fanout, "UNKNOWN_FANOUT").when(F.col("usage") == 0, "UNWIRED_CANDIDATE")
    rows = rows.withColumn("verdict", verdict).filter(F.col("verdict").isNotNull())
    return rows.select("path", "line", "name", "kind", "verdict", (F.col("kind") == "variable").alias("low_confidence_kind"))


def file_rep(symbols: DataFrame) -> DataFrame:
    """The symbol of smallest line of each file; of several the first by end and kind."""
    first = F.min(F.struct("line", "end_line", "kind", "name")).alias("s")
    return symbols.groupBy("path").agg(first).select("path", "s.line", "s.end_line", "s.kind", "s.name")


def innermost(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """``points`` (``src_path``, ``src_line``) with the innermost symbol around the line, else the file's first one.

    The equal path carries the join; among the symbols that contain the line the largest (line, end_line, kind) wins by one
    ``max_by`` with map-side combine instead of a sort.
    """
    keys = points.select("src_path", "src_line").distinct()
    s = symbols.select(F.col("path").alias("src_path"), F.col("line").alias("s_line"), F.col("end_line").alias("s_end"), F.col("kind").alias("s_kind"), F.col("name").alias("s_name"))
    holds = keys.join(s, "src_path").filter(F.col("src_line").between(F.col("s_line"), F.col("s_end")))
    best = holds.groupBy("src_path", "src_line").agg(F.max(F.struct("s_line", "s_end", "s_kind", "s_name")).alias("b"))
    rep = file_rep(symbols).select(F.col("path").alias("src_path"), F.struct(F.col("line").alias("s_line"), F.col("end_line").alias("s_end"), F.col("kind").alias("s_kind"), F.col("name").alias("s_name")).alias("r"))
    found = keys.join(best, ["src_path", "src_line"], "left").join(rep, "src_path", "left").withColumn("x", F.coalesce("b", "r"))
    return found.select("src_path", "src_line", F.col("x.s_line").alias("node_line"), F.col("x.s_end").alias("node_end"), F.col("x.s_kind").alias("node_kind"), F.col("x.s_name").alias("node_name"))


def collapse(refs: DataFrame) -> DataFrame:
    """One row for each edge key, multiplicities added; the name is no part of the key, and bad multiplicities count 1."""
    has = "multiplicity" in refs.columns
    mult = F.greatest(F.coalesce(F.col("multiplicity").cast("long"), F.lit(1)), F.lit(1)) if has else F.lit(1)
    return refs.groupBy("src_path", "src_line", "def_path", "def_line", "confidence").agg(F.sum(mult).cast("long").alias("mult"))


def targets(symbols: DataFrame) -> DataFrame:
    """(``def_path``, ``def_line``, ``dst_kind``, ``dst_name``, ``files``): the last symbol by (end_line, kind) of each place, and the files that define its name."""
    last = symbols.groupBy("path", "line").agg(F.max(F.struct("end_line", "kind", "name")).alias("t"))
    files = symbols.groupBy("name").agg(F.countDistinct("path").alias("files")).withColumnRenamed("name", "dst_name")
    return last.select(F.col("path").alias("def_path"), F.col("line").alias("def_line"), F.col("t.kind").alias("dst_kind"), F.col("t.name").alias("dst_name")).join(files, "dst_name")


def node_edges(refs: DataFrame, symbols: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """(``src_path``, ``src_node_line``, ``src_kind``, ``dst_path``, ``dst_line``, ``dst_kind``, ``weight``) between symbols; a null source is outside inflow.

    Targets match on path and line, the last of several by (end_line, kind); sources are the innermost symbol. References that
    carry both (``node_line``, ``node_kind``, ``dst_kind``, ``dst_name``, ``files``) need no join. Weights are sums, so edges of
    one key need not be added up first.
    """
    placed = refs.filter(F.col("def_path").isNotNull())
    if "node_line" not in refs.columns:
        hit = placed.join(targets(symbols), ["def_path", "def_line"])
        placed = hit.join(innermost(hit, symbols).select("src_path", "src_line", "node_line", "node_kind"), ["src_path", "src_line"])
    mult = F.greatest(F.coalesce(F.col("multiplicity").cast("long"), F.lit(1)), F.lit(1)) if "multiplicity" in refs.columns else F.lit(1)
    placed = placed.withColumn("w", confidence_weight("confidence", o) * mult * quality("dst_name", "files", o))
    loop = F.col("src_path").eqNullSafe(F.col("def_path")) & F.col("node_line").eqNullSafe(F.col("def_line")) & F.col("node_kind").eqNullSafe(F.col("dst_kind"))
    inner = F.col("node_line").isNotNull()
    placed = placed.filter(~(loop & inner))
    return placed.groupBy(F.when(inner, F.col("src_path")).alias("src_path"), F.col("node_line").alias("src_node_line"), F.col("node_kind").alias("src_kind"), F.col("def_path").alias("dst_path"), F.col("def_line").alias("dst_line"), "dst_kind").agg(F.sum("w").alias("weight"))


def occurrence_total(refs: DataFrame) -> int:
    """The sum of all multiplicities, 1 at least: matched or not."""
    return max(1, collapse(refs).agg(F.sum("mult")).first()[0] or 0)


def sample_paths(files: DataFrame, limit: int, focus: list[str] | None = None) -> DataFrame:
    """All files if they fit; else the focus files, then midpoints of equal parts of the sorted rest, with a ``label``."""
    total = files.count()
    if total <= limit:
        return files.select("path", F.lit("all").alias("label"))
    chosen = files.filter(F.col("path").isin(list(dict.fromkeys(focus or [])))).select("path").limit(limit)
    n_chosen = chosen.count() if focus else 0
    if n_chosen >= limit:
        return chosen.withColumn("label", F.lit("focus"))
    rest = files.select("path") if not focus else files.select("path").join(chosen, "path", "left_anti")
    slots, left = limit - n_chosen, total - n_chosen
    places = [min(left - 1, int((i + 0.5) * left / slots)) for i in range(slots)]
    ranked = positions(rest, ["path"]).filter(F.col("position").isin(places)).select("path")
    return chosen.unionByName(ranked).withColumn("label", F.lit("stratified"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``position`` from 0 in the given order, without sorting everything in one task.

    Rows are dealt by ranges that Spark samples, sorted inside, and stored with their partition and place in it; the sizes of the
    partitions before are added.
    """
    (row,) = [next(n for n in ("_row", "__row", "___row") if n not in df.columns)]
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "positions")
    part = F.shiftright(row, 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    place = F.col("_before") + F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(offsets, part == F.col("_part")).withColumn("position", place).drop(row, "_part", "_before")
