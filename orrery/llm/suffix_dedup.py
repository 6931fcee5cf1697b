"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform, bounded by a length.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller id, or same document and earlier start)
goes. Equal strings must meet in one task, so each window of ``LENGTH`` bytes is dealt by its minimiser, the k-gram of least
hash in it: equal windows have equal minimisers. Neighbouring windows with one minimiser form a context, a stretch of bytes.

1. All contexts, as slim rows, are dealt and sorted by the minimiser. Minimisers seen once are done. Contexts with equal
   bytes (by two 64-bit hashes) are one; all but the earliest are covered as a whole. That is settled among the texts of a
   chunk first, so a passage that a third of all texts share sends one context a chunk to its minimiser's task.
2. Different contexts of one minimiser are cut from the texts and brought together in blocks. A block's contexts are sorted
   into a Burrows-Wheeler transform. Breadth-first backward extension from the empty string derives the common prefixes of
   neighbours in increasing length and stops at ``LENGTH``: neighbours that got no value by then share so many bytes.
   In each run of such neighbours all starts but the earliest are covered.
3. A minimiser with more than ``CAP`` different contexts, such as one at the edge of a very common passage, would be one
   task's load. Its contexts are split into their windows, which are grouped by two 64-bit hashes with map-side combine.

Then the covered stretches of a document are merged and its text is cut. No text is ever gathered with other texts but as
contexts, and no row is capped or sampled.

Defined results. A null text counts as empty. Texts shorter than ``LENGTH`` stay whole. Null ids come after all others;
rows with one id are numbered once, as they are stored, so of repeated rows one stays whole. Empty tables give empty
results; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import freed, mapped, stored, table

LENGTH = 100
#: Bytes of a minimiser.
GRAM = 32
#: Bytes of text that a worker hashes at once; positions in it fill the low bits of the ordered values.
CHUNK_BITS = 20
#: Different contexts of one minimiser that go into one transform.
CAP = 5_000
#: Bytes of contexts in one transform, about.
BLOCK_BYTES = 1 << 18

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Never in UTF-8: ends each context in a block. Strings with it are never looked at.
_END = b"\xff"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        out[0], done, step = 1, 1, np.uint64(base)
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * step
            done += more
            step = step * step
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if which not in _tables:
        n = (1 << CHUNK_BITS) + 1
        _tables[which] = _powers(_BASES[which], n), _powers(pow(_BASES[which], -1, 1 << 64), n)
    return _tables[which]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Hashes of any stretches of a chunk, from prefix sums."""

    def __init__(self, chunk: np.ndarray, which: int):
        self.inverse = _table(which)[1]
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(chunk) + 1, np.uint64)
            np.cumsum(chunk * _table(which)[0][: len(chunk)], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts] + np.asarray(lengths).astype(np.uint64))


def contexts(chunk: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of the texts that end at ``ends``: first window, number of windows, minimiser hash, hash of the bytes."""
    n = len(chunk)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    first, width = Hashed(chunk, 0), LENGTH - GRAM + 1
    grams = first.of(np.arange(n - GRAM + 1), GRAM)
    low = np.uint64((1 << CHUNK_BITS) - 1)
    # of equal hashes the leftmost counts
    values = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    own_end = ends[np.searchsorted(ends, np.arange(windows), side="right")]
    starts = np.flatnonzero(np.arange(windows) + LENGTH <= own_end)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    a, m = starts[heads], np.diff(np.append(heads, len(starts)))
    return a, m, grams[at[a]].view(np.int64), Hashed(chunk, 1).of(a, m + LENGTH - 1).view(np.int64)


def _chunks(texts: list[memoryview | bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Chunks of bytes and their parts (text, offset in the text, end in the chunk); longer texts overlap by a window less one."""
    most = 1 << CHUNK_BITS
    parts, where, at = [], [], 0
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        if len(data) < LENGTH:
            continue
        for offset in range(0, len(data) - LENGTH + 1, most - LENGTH + 1):
            piece = data[offset : offset + most]
            if at + len(piece) > most:
                yield np.concatenate(parts), where
                parts, where, at = [], [], 0
            parts.append(piece)
            at += len(piece)
            where.append((i, offset, at))
    if parts:
        yield np.concatenate(parts), where


def repeated(h: np.ndarray, c: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which contexts have an equal one (``h``, ``c``) of smaller (order, start) among these."""
    out = np.zeros(len(h), bool)
    with np.errstate(over="ignore"):
        key = h * np.int64(-7046029254386353131) + c
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    some = np.zeros(len(h), bool)
    some[1:] |= same
    some[:-1] |= same
    rows = by[some]
    by = rows[np.lexsort((start[rows], order[rows], c[rows], h[rows]))]
    out[by[1:][(h[by[1:]] == h[by[:-1]]) & (c[by[1:]] == c[by[:-1]])]] = True
    return out


def _occurrences(docs: DataFrame) -> DataFrame:
    """(``h``, ``c``, ``ord``, ``a``, ``m``, ``again``) of all contexts of (``ord``, ``bytes``); ``again``: an equal one of the chunk is earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [x.as_buffer() if x.is_valid else b"" for x in batch.column(1)]
            for chunk, where in _chunks(texts):
                owner, offset, end = (np.array(x, np.int64) for x in zip(*where, strict=True))
                a, m, h, c = contexts(chunk, end)
                part = np.searchsorted(end, a, side="right")
                begin = np.concatenate([[0], end[:-1]])
                start, own = a - begin[part] + offset[part], order[owner[part]]
                again = repeated(h, c, own, start)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(own), pa.array(start.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(again)], ["h", "c", "ord", "a", "m", "again"])

    return mapped(docs, run, "h long, c long, ord long, a int, m int, again boolean")


def _sifted(occurrences: DataFrame, cap: int = CAP) -> DataFrame:
    """From rows sorted by (``again``, ``h``, ``c``, ``ord``, ``a``): ``kind`` 0 covered as a whole, 1 to be compared in a block, 2 to be split into windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], ["kind", "h", "ord", "a", "m"])

        last = None
        #: Distinct contexts of the minimiser that may go on in the next batch.
        held = np.zeros((0, 4), np.int64)
        over = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, o, a, m = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            known = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            if known.any():
                yield out(0, np.stack([h, o, a, m], axis=1)[known])
                h, c, o, a, m = (x[~known] for x in (h, c, o, a, m))
                if not len(h):
                    continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            if last is not None:
                new[0] = (h[0], c[0]) != last
            last = (h[-1], c[-1])
            rows = np.stack([h, o, a, m], axis=1)
            if not new.all():
                yield out(0, rows[~new])
            fresh = rows[new]
            if over is not None:
                more = fresh[:, 0] == over
                if more.any():
                    yield out(2, fresh[more])
                    fresh = fresh[~more]
            held = np.concatenate([held, fresh])
            if not len(held):
                continue
            whole = held[:, 0] != held[-1, 0]
            yield from several(held[whole], out)
            held = held[~whole]
            if len(held) > cap:
                yield out(2, held)
                over, held = held[0, 0], held[:0]
        yield from several(held, out)

    def several(rows: np.ndarray, out) -> Iterator[pa.RecordBatch]:
        if len(rows):
            edge = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            count = np.diff(np.append(edge, len(rows)))
            n = np.repeat(count, count)
            if (n > cap).any():
                yield out(2, rows[n > cap])
            some = (n > 1) & (n <= cap)
            if some.any():
                yield out(1, rows[some])

    return mapped(occurrences, run, "kind int, h long, ord long, a int, m int")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their first 128 bytes or more: prefix doubling from packed words of 8 bytes.

    Ties may stand in any order: intervals of shorter prefixes hold them all.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    width = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1])).astype(np.uint64)
        if width >= 128 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.uint64)
        after[: n - width] = rank[width:] + np.uint64(1)
        key = (rank << np.uint64(32)) | after
        width *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order`` where it is under ``bound``, else -1.

    Breadth first: an interval of the transform is all suffixes with one prefix; extended backward by a character it
    is an interval again. Only intervals whose left edge got its value in the last round can give new edges.
    """
    n = len(text)
    bwt = text[order - 1]
    inverse = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)
    forward[inverse] = np.arange(n)
    sorted_bwt = bwt[inverse]
    same = sorted_bwt[1:] == sorted_bwt[:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[inverse[1:][same]] = inverse[:-1][same]
    after[inverse[:-1][same]] = inverse[1:][same]
    values = np.full(n, -1, np.int32)
    low, high = np.array([0]), np.array([n])
    for level in range(bound):
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
        first = forward[at[before[at] < np.repeat(low, sizes)]]
        last = forward[at[after[at] >= np.repeat(high, sizes)]]
        first.sort()
        last.sort()
        new = values[first] < 0
        low, high = first[new], last[new] + 1
        values[low] = level
        if not len(low):
            break
    return values


def covered_starts(parts: list[bytes], order: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start) of all windows in the contexts that a context of smaller (order, start) has too."""
    text = np.frombuffer(b"".join(p + _END for p in parts), np.uint8)
    lengths = np.array([len(p) + 1 for p in parts])
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(parts)), lengths)
    inner = np.arange(len(text)) - begins[owner]
    suffixes = suffix_order(text)
    group = np.cumsum(common_prefixes(text, suffixes, LENGTH) >= 0)
    valid = inner[suffixes] < windows[owner[suffixes]]
    at, group = suffixes[valid], group[valid]
    o, s = order[owner[at]], starts[owner[at]] + inner[at]
    by = np.lexsort((s, o, group))
    again = by[1:][group[by[1:]] == group[by[:-1]]]
    return o[again], s[again]


def _runs(o: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts as (order, first start, number)."""
    by = np.lexsort((s, o))
    o, s = o[by], s[by]
    head = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1))) if len(o) else np.zeros(0, np.int64)
    return o[head], s[head], np.diff(np.append(head, len(o)))


def _compared(cut: DataFrame) -> DataFrame:
    """Covered stretches (``ord``, ``a``, ``m``) among contexts sorted by ``h``; a block ends between two minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            o, s, m = _runs(*covered_starts([r[4] for r in rows], *(np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))))
            return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32))], ["ord", "a", "m"])

        block, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= BLOCK_BYTES and row[0] != block[-1][0]:
                    yield solve(block)
                    block, size = [], 0
                block.append(row)
                size += len(row[4])
        if block:
            yield solve(block)

    return mapped(cut, run, "ord long, a int, m int")


def _windows(cut: DataFrame) -> DataFrame:
    """(``x``, ``y``, ``ord``, ``a``): both hashes of every window of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, start, count = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            lengths = count + LENGTH - 1
            for lo in range(0, batch.num_rows, 2000):
                hi = min(lo + 2000, batch.num_rows)
                text = np.frombuffer(b"".join(batch.column(4)[lo:hi].to_pylist()), np.uint8)
                begins = np.cumsum(lengths[lo:hi]) - lengths[lo:hi]
                inner = np.arange(count[lo:hi].sum()) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
                at = np.repeat(begins, count[lo:hi]) + inner
                x, y = (Hashed(text, i).of(at, LENGTH).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.repeat(order[lo:hi], count[lo:hi])), pa.array((np.repeat(start[lo:hi], count[lo:hi]) + inner).astype(np.int32))], ["x", "y", "ord", "a"])

    return mapped(cut, run, "x long, y long, ord long, a int")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted contexts' bytes: (``h``, ``ord``, ``a``, ``m``, ``ctx``, ``kind``)."""
    lists = wanted.groupBy("ord").agg(F.collect_list(F.struct("h", "a", "m", "kind")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, o, want = batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                h, a, m, kind = zip(*((w["h"], w["a"], w["m"], w["kind"]) for w in want), strict=True)
                ctx = [text[x : x + k + LENGTH - 1] for x, k in zip(a, m, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array([o] * len(h), pa.int64()), pa.array(a, pa.int32()), pa.array(m, pa.int32()), pa.array(ctx, pa.binary()), pa.array(kind, pa.int32())], ["h", "ord", "a", "m", "ctx", "kind"]
                )

    return mapped(docs.join(lists, "ord").select("ord", "bytes", "want"), run, "h long, ord long, a int, m int, ctx binary, kind int")


def _ordered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``ord`` (unique, in the order of the ids) and ``bytes``.

    Integer ids without null or repetition are their own order. Otherwise the ids are sorted once, over all executors, and numbered.
    """
    text = F.col(text_col).cast("binary").alias("bytes")
    whole = dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    if whole and df.select(id_col).groupBy(id_col).count().filter(f"count > 1 OR `{id_col}` IS NULL").isEmpty():
        return df.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("ord"), text)
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text), "numbered")
    sorted_rows = rows.select("row", "id").repartitionByRange(F.col("id").isNull(), "id", "row").sortWithinPartitions(F.col("id").isNull(), "id", "row")
    numbers = stored(sorted_rows.select("row", F.monotonically_increasing_id().alias("ord")), "order")
    return stored(rows.join(numbers, "row").select("id", "ord", "bytes"), "ordered")


def repeated_stretches(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """(``ord``, ``a``, ``m``): m windows from a on start earlier elsewhere; of documents (``ord``, ``bytes``)."""
    spark = docs.sparkSession
    # what is known to be covered goes anywhere
    dealt = F.when(F.col("again"), F.xxhash64("ord", "a")).otherwise(F.col("h"))
    occurrences = _occurrences(docs.select("ord", "bytes")).repartition(dealt).sortWithinPartitions("again", "h", "c", "ord", "a")
    sifted = stored(_sifted(occurrences, cap), "sifted")
    covered = sifted.filter("kind = 0").select("ord", "a", "m")
    wanted = sifted.filter("kind > 0")
    freed(spark)
    cut = stored(_cut(docs, wanted), "contexts")
    freed(spark)
    near = cut.filter("kind = 1").select("h", "ord", "a", "m", "ctx").repartition("h").sortWithinPartitions("h")
    near = stored(_compared(near), "compared")
    split = stored(_windows(cut.filter("kind = 2").select("h", "ord", "a", "m", "ctx")), "windows")
    first = split.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "a")).alias("first")).filter("n > 1").drop("n")
    hot = split.join(first, ["x", "y"]).filter(F.struct("ord", "a") != F.col("first")).select("ord", "a", F.lit(1).alias("m"))
    return covered.unionByName(near).unionByName(hot)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_kept: bool = True, cap: int = CAP) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept`` (binary) on demand."""
    kind = dict(df.dtypes)[id_col]
    docs = _ordered(df, id_col, text_col)
    lists = repeated_stretches(docs, cap).groupBy("ord").agg(F.collect_list(F.struct("a", "m")).alias("spans"))
    lists = stored(lists, "spans")
    freed(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, sha, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                text, want = batch.column(1)[i].as_py() or b"", batch.column(2)[i].as_py()
                rest, removed, n = text, 0, 0
                if want:
                    a = np.array([w["a"] for w in want], np.int64)
                    b = a + np.array([w["m"] for w in want], np.int64) + LENGTH - 1
                    by = np.argsort(a, kind="stable")
                    a, b = a[by], np.maximum.accumulate(b[by])
                    new = np.append(True, a[1:] > b[:-1])
                    a, b = a[new], b[np.append(new[1:], True)]
                    removed, n = int((b - a).sum()), len(a)
                    cuts = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
                    rest = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                total.append(len(text))
                gone.append(removed)
                spans.append(n)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(sha, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return mapped(docs.join(lists, "ord", "left").select("id", "bytes", "spans"), run, schema)


def op8_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document remains without repeated strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
