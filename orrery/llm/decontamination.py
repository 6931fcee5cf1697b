"""Benchmark decontamination by spaced-seed hashing (seeds after Ma, Tromp and Li's PatternHunter).

A mask fixes which token positions of a window count; the others may differ. The masked windows of the benchmark
items and of the documents are hashed and joined; around every hit the item is laid along the document on the hit's
diagonal, and the best stretch (a match scores 1, a substitution -2) decides. An overlap is reported where the stretch
has ``MATCHES`` equal tokens, or four fifths of a shorter item, and at most one substitution in five tokens.

The benchmark is the stated query set: it is cut into blocks of ``BLOCK_BYTES`` of text, and all documents pass by each block in
a job of its own. So a task never holds more than one block, nothing unbounded is sent, and no text is shuffled.

Defined results. Tokens are runs of letters and digits, lower-cased. Null and empty texts have none. An item of fewer
than ``SPAN`` tokens has no seed: it is hashed whole and overlaps where all of its tokens follow each other. Repeated items and repeated
documents are each reported; null ids are kept as null. Empty tables give an empty result. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ._common import mapped, numbered, ship, slices, stored, table

#: Fixed masks of one span: each has six positions that count, first and last included.
MASKS = ("11010010011", "10110001101", "11001100101", "10011101001")
SPAN = len(MASKS[0])
#: Equal tokens of an overlap, and its least share of equal tokens.
MATCHES, IDENTITY = 12, 0.8
#: Benchmark text that is sent to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Document text that a worker turns into tokens at once.
CHUNK_BYTES = 2 << 20

_words = re.compile(r"[^\W_]+").findall
_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_MULTIPLIERS = (np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tokens(text: str | None) -> list[str]:
    return _words((text or "").lower())


def masked_hashes(ids: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Window starts all of whose counted tokens are known (not 0), and the hashes there."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids != 0
    ok = known[offsets[0] : offsets[0] + n].copy()
    for o in offsets[1:]:
        ok &= known[o : o + n]
    starts = np.flatnonzero(ok)
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets:
            out ^= ids[starts + o].astype(np.uint64) * _MULTIPLIERS[o]
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return starts, out


class Items:
    """A block of benchmark items: token numbers, and the seeds of each mask, and of each length below the span, sorted by hash."""

    def __init__(self, texts: list[str | None]):
        self.numbers: dict[str, int] = {}
        lists = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in tokens(t)] for t in texts]
        self.tokens = [np.array(x, np.int32) for x in lists]
        self.seeds = []
        short = sorted({len(x) for x in self.tokens if 0 < len(x) < SPAN})
        self.masks = [(offsets, SPAN) for offsets in _OFFSETS] + [(np.arange(n), n) for n in short]
        for offsets, span in self.masks:
            own = [(i, x) for i, x in enumerate(self.tokens) if span == SPAN or len(x) == span]
            found = [(h, np.full(len(s), i, np.int32), s.astype(np.int32)) for i, x in own for s, h in [masked_hashes(x, offsets, span)]]
            h, i, s = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]) for k in range(3))
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], i[order], s[order]))

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) of all hits; a diagonal is the document's position of the item's first token."""
        found = []
        for (offsets, span), (hashes, items, starts) in zip(self.masks, self.seeds, strict=True):
            at, h = masked_hashes(ids, offsets, span)
            low = np.searchsorted(hashes, h)
            high = np.searchsorted(hashes, h, side="right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                reps = high[hit] - low[hit]
                k = np.repeat(low[hit], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                found.append(np.stack([items[k].astype(np.int64), np.repeat(at[hit], reps) - starts[k]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def verify(self, ids: np.ndarray, first: int, last: int, item: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """A best stretch of the item on the diagonal inside tokens first to last that is an overlap: (document start, item start, length, equal tokens)."""
        own = self.tokens[item]
        a, b = max(0, first - diagonal), min(len(own), last - diagonal)
        equal = own[a:b] == ids[diagonal + a : diagonal + b]
        sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
        lows = np.minimum.accumulate(sums)
        gains = sums - lows
        # of equally good stretches the longer ones have more equal tokens, the shorter ones a greater share of them
        for end in np.flatnonzero(gains == gains.max()):
            for start in np.flatnonzero(sums[: end + 1] == lows[end]):
                matches = int(equal[start:end].sum())
                if matches >= min(MATCHES, math.ceil(IDENTITY * len(own))) and matches >= IDENTITY * (end - start):
                    return diagonal + a + int(start) - first, a + int(start), int(end - start), matches
        return None


def _overlaps(texts: list[str | None], items: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, text start, item start, length, equal tokens) of every overlap; texts lie apart by a span of unknown tokens."""
    parts, bounds, at = [], [], 0
    gap = np.zeros(SPAN, np.int32)
    get = items.numbers.get
    for text in texts:
        words = tokens(text)
        parts += [np.fromiter((get(w, 0) for w in words), np.int32, len(words)), gap]
        bounds.append((at, at + len(words)))
        at += len(words) + SPAN
    ids = np.concatenate(parts) if parts else gap
    found = items.candidates(ids)
    if not len(found):
        return
    firsts = np.array([b[0] for b in bounds])
    for item, diagonal in found:
        # the seed lies inside one text; the diagonal may begin before it
        own = items.tokens[item]
        for k in range(max(0, int(np.searchsorted(firsts, diagonal, side="right")) - 1), len(bounds)):
            first, last = bounds[k]
            if first >= diagonal + len(own):
                break
            if last > diagonal and (best := items.verify(ids, first, last, int(item), int(diagonal))):
                yield (k, int(item), *best)


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[bool, list, list[str | None]]]:
    """Blocks of about ``block_bytes``, dealt by hash: whether there are more, ids and texts; an empty benchmark is one empty block."""
    own = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text"))
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("text", F.col("id").cast("string")), F.lit(blocks)))
    if blocks > 1:
        # sorted by block: reading one skips the row groups of all others
        dealt = stored(dealt.repartitionByRange("block").sortWithinPartitions("block"), "items")
    for block in range(blocks):
        rows = sorted(dealt.filter(F.col("block") == block).select("id", "text").collect(), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        yield blocks > 1, [r[0] for r in rows], [r[1] for r in rows]


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns; no text is shuffled."""
    ship(docs.sparkSession)

    def test(texts: list[str | None]):
        @pandas_udf("boolean")
        def free(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
            items = Items(texts)
            for batch in column:
                rows = batch.tolist()
                ok = np.ones(len(rows), bool)
                for a, b in slices([len(t or "") for t in rows], CHUNK_BYTES):
                    ok[[a + found[0] for found in _overlaps(rows[a:b], items)]] = False
                yield pd.Series(ok)

        return free

    rows = row = leaks = None
    for several, _, texts in item_blocks(benchmark, item_id, item_text, block_bytes):
        if not several:
            return docs.filter(test(texts)(F.col(f"`{text_col}`")))
        if rows is None:
            rows, row = numbered(docs)
        found = stored(rows.filter(~test(texts)(F.col(f"`{text_col}`"))).select(row), "leaks")
        leaks = found if leaks is None else leaks.unionByName(found)
    return rows.join(leaks.distinct(), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``id_col``, ``item_id``, ``doc_start``, ``item_start``, ``n_tokens`` and ``n_equal``, one for each overlap (positions in tokens)."""
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_id]
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, doc_start int, item_start int, n_tokens int, n_equal int"
    slim = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))

    def run_with(ids: list, texts: list[str | None]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(texts)
            for batch in batches:
                column = batch.column(1).to_pylist()
                for a, b in slices([len(t or "") for t in column], CHUNK_BYTES):
                    found = list(_overlaps(column[a:b], items))
                    if found:
                        k, item, *rest = zip(*found, strict=True)
                        own = batch.column(0).take(pa.array([a + i for i in k], pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [own, pa.array([ids[i] for i in item]), *(pa.array(r, pa.int32()) for r in rest)], [id_col, item_id, "doc_start", "item_start", "n_tokens", "n_equal"]
                        )

        return run

    out = None
    for several, ids, texts in item_blocks(benchmark, item_id, item_text, block_bytes):
        found = mapped(slim, run_with(ids, texts), schema)
        if several:
            found = stored(found, "overlaps")
        out = found if out is None else out.unionByName(found)
    return out


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents and the benchmark items they overlap: one row for each pair, its overlaps summed up."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_overlaps"), F.max("n_equal").alias("most_equal"), F.sum("n_equal").alias("n_equal"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_start").alias("first_start")
    )
