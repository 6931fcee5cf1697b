"""Near-duplicate detection by bottom-k sketches from one hash function (after Broder; Cohen and Kaplan).

Every distinct word shingle has one 64-bit hash; a document's sketch is its ``K`` smallest. Documents with one shingle
set are one node from then on. Inverted lists of retained values generate candidate pairs; the K smallest of two
sketches' union estimate the similarity; the full sets of what the estimate lets through are compared.

The threshold is ``percent``: ``PERCENT`` is the contract of op9; near-duplicate stages pass ``STAGE_PERCENT``.

Which lists count. Two sets at the threshold share ``needed(percent)`` values of their sketches or more, but for a chance of
``MISS``; so of each sketch only the ``size - needed + 1`` rarest values (by the counts over the whole corpus) need lists. Values that very many documents share drop out of all but those documents that consist of them.

Groups. Nodes that lists connect are a group; a group that grew beyond ``GROUP_MAX`` nodes is taken apart into its lists
again. A group's sets are compared in blocks of about ``BLOCK`` nodes and ``BLOCK_BYTES``: a task gets two blocks, estimates
all similarities from the sketches by one product of incidence matrices, counts the intersections of the full sets of those
nodes that the estimate leaves a partner, and returns a spanning forest of the links, never all pairs. So no list is cut, no task
gets more than two blocks, and each set is sent once for each block of its group. Components come from the forests.

Defined results. Null and empty texts have no shingle and are linked with nothing. Equal sets are linked whatever the
ids. Rows repeated with one id share a component and are all kept or all dropped. A null id is never a component's
name unless all ids in it are null. Empty tables give empty results; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, freed, mapped, numbered, stored, table, with_group
from .components import connected_components

WORDS = 5
#: Links have 100 * intersection >= percent * union: op9's contract, and the threshold of near-duplicate stages.
PERCENT, STAGE_PERCENT = 85, 80
K = 32
#: Greatest chance that two full sketches at the threshold share fewer values than ``needed``.
MISS = 4e-6
#: Nodes of a block and bytes of its sets, about, and nodes of a group that is not taken apart.
BLOCK, BLOCK_BYTES, GROUP_MAX = 512, 8 << 20, 20_000
#: Nodes up to which their ids are sent to all tasks that look for their texts; beyond, texts and ids are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Words a worker remembers the hash of; then it starts anew.
CACHE_WORDS = 300_000


@cache
def needed(percent: int) -> int:
    """Shared values of two full sketches at the threshold, but for a chance of ``MISS``: a binomial tail."""
    p, below, need = percent / 100, 0.0, 0
    while need < K and (below := below + comb(K, need) * p**need * (1 - p) ** (K - need)) <= MISS:
        need += 1
    return max(1, need)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _WordHash()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; one for the whole sequence if it has fewer words."""
    # bytes.split() parts at exactly the six ASCII white-space characters
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ h[i : i + n]) * _ODD[i]
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketches(df: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
    """``row`` (one number a row: the column ``row`` if given), ``id``, ``n_shingles``, ``node`` (digest of the set; null if it is empty) and ``sketch`` (signed, in the hash's own order)."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, kept = [], [], []
            for x in batch.column(2):
                s = shingles(x.as_py() or b"")
                n.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                kept.append(s[:K].view(np.int64))
            ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "n_shingles", "node", "sketch"])

    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return mapped(df.select(number.alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary")), run, f"row long, id {kind}, n_shingles long, node binary, sketch array<long>")


def inverted_lists(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(``value``, ``node``) for the rarest values of each sketch that another sketch has too."""
    each = nodes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = each.join(shared, "value", "left").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "value"))).alias("values")
    )
    size = F.size("values")
    need = F.least(F.lit(needed(percent)), F.ceil(F.col("n") * percent / 100).cast("int"))
    rare = F.slice("values", F.lit(1), size - need + 1)
    return ranked.select("node", F.explode(rare).alias("x")).filter("x.df > 1").select("x.value", "node", "x.df")


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, send: bool) -> DataFrame:
    """``node`` and ``set``, the bytes of its sorted shingle hashes, for the wanted (``node``, ``digest``, ``rep``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = shingles(text.as_py() or b"").tobytes()
                # repeated ids may have other texts
                if hashlib.blake2b(data, digest_size=16).digest() == digest:
                    nodes.append(node)
                    sets.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))
    joined = source.join(F.broadcast(wanted) if send else wanted, F.col("_id").eqNullSafe(F.col("rep")))
    return mapped(joined.select("node", "digest", "text"), run, "node long, set binary")


def intersections(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets (of all, if 0) with the others (all)."""
    n = len(sets)
    rows, columns = slice(0, left or n), slice(left, n)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    run = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1
    shared = np.bincount(run)[run] > 1
    run, owner = np.unique(run[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((left or n, n - left), np.float32)
    step = 4096
    bounds = np.searchsorted(run, np.arange(0, (run[-1] + 1 if len(run) else 0) + step, step))
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        incidence = np.zeros((n, step), np.float32)
        incidence[owner[a:b], run[a:b] - k * step] = 1
        common += incidence[rows] @ incidence[columns].T
    # whole numbers far below 2**24: exact
    return common.astype(np.int64)


def plausible(sets: list[np.ndarray], left: int, percent: int) -> np.ndarray:
    """Whether the sizes and the union sketch allow the threshold, for the pairs of ``intersections``.

    The sketch of a union is the K smallest values of both sketches. A value in both sketches is in it unless K values of the union
    are smaller, so the number of shared sketch values is an upper bound of the hits that the estimate counts.
    """
    sizes = np.array([len(x) for x in sets])
    a, b = sizes[: left or len(sets), None], sizes[None, left:]
    small, large = np.minimum(a, b), np.maximum(a, b)
    least = np.minimum(needed(percent), -(-small * percent // 100))
    return (small * 100 >= percent * large) & (intersections([x[:K] for x in sets], left) >= least)


def linked(sets: list[np.ndarray], left: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; with ``left`` over 0, of those between the first ``left`` sets and the others."""
    may = plausible(sets, left, percent)
    if not left:
        np.fill_diagonal(may, False)
    # only nodes with a candidate go on to their full sets
    rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0)) + left
    if not len(rows):
        return []
    chosen = rows.tolist() + columns.tolist() if left else rows.tolist()
    part = len(rows) if left else 0
    own = [sets[i] for i in chosen]
    common = intersections(own, part)
    sizes = np.array([len(x) for x in own])
    union = sizes[: part or len(own), None] + sizes[None, part:] - common
    may = may[np.ix_(rows, columns - left)]
    parent = list(range(len(own)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(may & (100 * common >= percent * union)), strict=True):
        x, y = int(a), int(b) + part
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((chosen[x], chosen[y]))
    return out


def _links(dealt: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``) from (``grp``, ``i``, ``j``, ``block``, ``node``, ``set``) sorted by all but the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
            nodes, sets = [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows]
            left = sum(r[0] == key[1] for r in rows) if key[1] != key[2] else 0
            pairs = linked(sets, left, percent) if len(rows) > left else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in pairs], pa.int64()), pa.array([nodes[y] for _, y in pairs], pa.int64())], ["a", "b"])

        key, rows = None, []
        for batch in batches:
            for g, i, j, block, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != key:
                    if len(rows) > 1:
                        yield solve(key, rows)
                    key, rows = (g, i, j), []
                # a node whose text was found twice
                if not rows or rows[-1][1] != node:
                    rows.append((block, node, data))
        if len(rows) > 1:
            yield solve(key, rows)

    return mapped(dealt, run, "a long, b long")


def _grouped(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """(``grp``, ``node``, ``blocks``): groups of nodes that lists connect, or single lists where a group is too large; with its number of blocks.

    ``sizes`` has the ``bytes`` of each node's set.
    """
    heads = lists.groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count(F.lit(1)).alias("n")).filter("a <> z")
    heads = stored(heads, "heads")
    total = heads.agg(F.sum("n")).first()[0] or 0
    groups = connected_components(with_group(lists.select("value", "node"), heads, ["value"], "n", total).filter("node <> a").select("a", F.col("node").alias("b")))
    groups = stored(groups.join(sizes, "node"), "grouped")
    numbers = stored(groups.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes")), "numbers")
    n_nodes = numbers.agg(F.sum("size")).first()[0] or 0
    whole = with_group(groups.select("comp", "node"), numbers.filter(F.col("size") <= GROUP_MAX), ["comp"], "size", n_nodes)
    whole = whole.select(F.concat(F.lit("g"), F.col("comp").cast("string")).alias("grp"), "node", "size", "bytes")
    large = with_group(groups.select("comp", "node", F.col("bytes").alias("own")), numbers.filter(F.col("size") > GROUP_MAX).select("comp", "size"), ["comp"], "size", n_nodes)
    parts = lists.select("value", "node").join(large.select("node", "own"), "node")
    lengths = stored(parts.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.sum("own").alias("bytes")), "lengths")
    parts = with_group(parts.select("value", "node"), lengths, ["value"], "size", total).select(F.concat(F.lit("v"), F.col("value").cast("string")).alias("grp"), "node", "size", "bytes")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    return whole.unionByName(parts).select("grp", "node", F.least(F.col("size").cast("int"), blocks).alias("blocks"))


def _labelled(df: DataFrame, id_col: str, text_col: str, percent: int, row: str | None = None) -> DataFrame:
    """Per row: ``row``, ``id``, ``n_shingles`` and ``comp``, the number of its component (null without shingles)."""
    rows = stored(sketches(df, id_col, text_col, row), "sketches")
    nodes = rows.filter(F.col("node").isNotNull()).groupBy(F.col("node").alias("digest")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # numbered once and stored: half the bytes of a digest, and they compress
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    freed(df.sparkSession)
    lists = stored(inverted_lists(nodes, percent), "lists")
    freed(df.sparkSession)
    grouped = stored(_grouped(lists, nodes.select("node", (F.col("n_shingles") * 8).alias("bytes"))), "groups")
    wanted = nodes.select("node", "digest", "rep").join(grouped.select("node").distinct(), "node", "left_semi")
    sets = stored(_sets(df, id_col, text_col, wanted, grouped.count() <= BROADCAST_NODES), "sets")
    # a node of block i goes to the pairs of blocks (i, j) for all j
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = grouped.join(sets, "node").withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "set")
    dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "block", "node")
    links = stored(_links(dealt, percent), "links")
    dropped(sets)
    freed(df.sparkSession)
    components = connected_components(links)
    named = nodes.select(F.col("digest").alias("node"), "n_rows", F.col("node").alias("number")).join(components.withColumnRenamed("node", "number"), "number", "left")
    named = stored(named.select("node", "n_rows", F.coalesce("comp", "number").alias("comp")), "named")
    slim = rows.select("row", "id", "n_shingles", "node")
    some = with_group(slim.filter(F.col("node").isNotNull()), named, ["node"], "n_rows", named.agg(F.sum("n_rows")).first()[0] or 0)
    none = slim.filter(F.col("node").isNull()).withColumn("comp", F.lit(None).cast("long"))
    return some.select("row", "id", "n_shingles", "comp").unionByName(none.select("row", "id", "n_shingles", "comp"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``."""
    named = _labelled(df, id_col, text_col, percent)
    named = stored(named, "components")
    names = stored(named.groupBy("comp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "names")
    out = with_group(named, names, ["comp"], "n", names.agg(F.sum("n")).first()[0] or 0)
    component = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component, all columns; one row of each."""
    rows, row = numbered(df)
    named = stored(_labelled(rows, id_col, text_col, percent, row).filter(F.col("comp").isNotNull()), "components")
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = stored(named.groupBy("comp").agg(F.min_by("row", order).alias("first"), F.count(F.lit(1)).alias("n")), "names")
    total = first.agg(F.sum("n")).first()[0] or 0
    dropped_rows = with_group(named, first.filter("n > 1"), ["comp"], "n", total).filter(F.col("row") != F.col("first")).select(F.col("row").alias(row))
    return rows.join(dropped_rows, row, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def op9_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return near_components(table(spark, sf_dir, "documents"), percent=PERCENT)
