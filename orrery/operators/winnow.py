"""Winnowed word grams of whole texts, on Python workers by numpy: MD5 for thousands of grams at a time."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import DEFAULTS, Options
from ..runtime import ship

#: Bytes of text that are looked at together, and grams that are hashed together: the latter's arrays stay in the cache.
TEXT_BYTES, GRAMS = 1 << 20, 1 << 13
#: A longer message has no room for its end and length in one block.
ONE_BLOCK = 55

_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_KEPT = np.array([[255] * n + [0] * (64 - n) for n in range(ONE_BLOCK + 1)], np.uint8).view(np.uint64)
_ENDS = np.array([[0] * n + [128] + [0] * (55 - n) + list((8 * n).to_bytes(8, "little")) for n in range(ONE_BLOCK + 1)], np.uint8).view(np.uint64)


def _one_block(words: np.ndarray) -> np.ndarray:
    """The first word of the MD5 of each block, ``words`` (16, n)."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in start)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=t), out=t), out=t)
        elif kind == 1:
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=t), out=t), out=t)
        elif kind == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=t), d, out=t)
        else:
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=t), out=t), out=t)
        np.add(t, a, out=t)
        np.add(t, np.uint32(_SINES[i]), out=t)
        np.add(t, words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16], out=t)
        turn = _TURNS[kind][i % 4]
        np.right_shift(t, np.uint32(32 - turn), out=u)
        np.left_shift(t, np.uint32(turn), out=t)
        np.bitwise_or(t, u, out=t)
        # the oldest word's array takes the new one
        np.add(b, t, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(start[0])


def md5_heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each slice of ``data``, as ``scalars.hash32`` has them. 64 bytes must follow the last start."""
    out = np.empty(len(starts), np.uint32)
    n = ends - starts
    blocks = np.ndarray((len(data) - 63,), "V64", data, 0, (1,))
    short = np.flatnonzero(n <= ONE_BLOCK)
    for k in range(0, len(short), GRAMS):
        at = short[k : k + GRAMS]
        block = blocks[starts[at]].view(np.uint64).reshape(-1, 8)
        block &= _KEPT[n[at]]
        block |= _ENDS[n[at]]
        out[at] = _one_block(np.ascontiguousarray(block.view("<u4").T)).byteswap()
    raw = data.tobytes() if len(short) < len(n) else b""
    for i in np.flatnonzero(n > ONE_BLOCK):
        out[i] = int.from_bytes(hashlib.md5(raw[starts[i] : ends[i]]).digest()[:4], "big")
    return out


def winnowed(texts: list[bytes], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, value), distinct: of texts that are words with one space between, none of them empty.

    Fewer words than ``k`` give one hash of all, fewer grams than ``w`` their minimum, else the minimum of every full window.
    """
    joined = b" ".join(texts)
    data = np.frombuffer(joined + bytes(64), np.uint8)
    gaps = np.flatnonzero(data[: len(joined)] == 32)
    word_starts, word_ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    first = np.searchsorted(word_starts, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]))
    words = np.diff(np.append(first, len(word_starts)))
    grams = np.maximum(1, words - k + 1)
    text = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = first[text] + at
    hashes = md5_heads(data, word_starts[begin], word_ends[np.minimum(begin + k, (first + words)[text]) - 1])
    least, left = hashes.copy(), grams[text] - at
    for j in range(1, w):
        np.minimum(least[:-j], hashes[j:], out=least[:-j], where=left[:-j] > j)
    full = at < np.maximum(1, grams - w + 1)[text]
    return tuple(x.astype(np.int64) for x in np.divmod(np.unique((text.astype(np.uint64) << np.uint64(32) | least)[full]), np.uint64(1 << 32)))


def text_index(docs: DataFrame, key: str, text: Column | str = "text", o: Options = DEFAULTS) -> DataFrame:
    """(``key``, ``fp_value``): ``clones.fingerprint_index`` of the texts' words of a-z and 0-9, lower-cased."""
    ship(docs.sparkSession)
    k, w = o.winnow_k, o.winnow_w
    # case and words as Spark has them: what the workers get is ASCII
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    rows = docs.select(F.col(key), F.encode(plain, "UTF-8").alias("_t")).filter(F.length("_t") > 0)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = size = 0
            for i, t in enumerate(texts, 1):
                size += len(t)
                if size >= TEXT_BYTES or i == len(texts):
                    where, values = winnowed(texts[begin:i], k, w)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where + begin)), pa.array(values)], names=[key, "fp_value"])
                    begin, size = i, 0

    schema = rows.select(key).schema.add("fp_value", "long")
    return rows.mapInArrow(run, schema)
