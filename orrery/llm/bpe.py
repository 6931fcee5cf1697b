"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every byte prefix of a piece the encoder keeps the one last token that the encoding of this prefix
ends with. A token t may follow the last token s of an earlier prefix only if the pair (s, t) survives
the merges, and exactly one suffix token of a prefix does. So the table of a prefix never changes when
bytes are appended, and after an edit only the table near the edit is filled anew.

Defined results. A null or empty text has no tokens. A byte that no token covers is an error in the
vocabulary and raises. Long pieces cost time in proportion to their length. Rows are independent, so
repeated ids, ties, empty tables and further columns do not matter; output columns are new names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import mapped, table

#: Pieces that a worker keeps in each of two generations: a full young generation becomes the old one, whose pieces
#: come back when they are used again. So memory stays bounded whatever the corpus, and frequent pieces stay.
CACHE_PIECES = 200_000
#: Pieces longer than this are encoded each time.
CACHE_PIECE_CHARS = 64


class Vocabulary:
    """Token bytes by rank, the two parts each token was merged from, and which pairs may stand together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self.size = max(ranks.values(), default=-1) + 1
        self._fits: dict[int, bool] = {}
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(self.size)]
        automaton = ahocorasick.Automaton()
        for word, rank in ranks.items():
            automaton.add_word(word.decode("latin-1"), rank)
        automaton.make_automaton()
        self._matches = automaton.iter

    def parts(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token; None for a single byte."""
        if token not in self._parts:
            word = self.bytes_of[token]
            pieces = [word[i : i + 1] for i in range(len(word))]
            while len(pieces) > 2:
                made = [(self.ranks.get(pieces[i] + pieces[i + 1], token), i) for i in range(len(pieces) - 1)]
                rank, i = min(made)
                if rank >= token:
                    raise ValueError(f"token {token} can't be reached by merges")
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self._parts[token]

    def fill(self, piece: bytes, last: list[int]) -> None:
        """Append to ``last`` the last tokens of all longer prefixes of the piece; ``last[i]`` is that of the first i bytes."""
        known, fits, size, length = self._fits.get, self.fits, self.size, self.length
        filled = len(last) - 1
        # all tokens that end at each byte, found by one automaton; a match that begins before the start is longer than any token
        for at, token in self._matches(piece.decode("latin-1"), max(0, filled + 1 - self.longest)):
            if at < filled:
                continue
            if at > filled:
                break
            start = at + 1 - length[token]
            if start:
                key = last[start] * size + token
                ok = known(key)
                if not (fits(last[start], token) if ok is None else ok):
                    continue
            last.append(token)
            filled += 1
        if filled < len(piece):
            raise ValueError("the vocabulary does not cover these bytes")

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes together is these two tokens.

        The merges are undone from the latest back: a merge across the border of a rank under all the
        merges undone so far would have come first, and then the two tokens would never have formed.
        """
        key = left * self.size + right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * CACHE_PIECES:
                self._fits.clear()
            known = self._fits[key] = self._survives(left, right)
        return known

    def _survives(self, left: int, right: int) -> bool:
        bound = len(self.ranks) + 256
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < bound:
                return False
            inner, outer = self.parts(left), self.parts(right)
            if inner is None and outer is None:
                return True
            # of two equal ranks the left merge comes first, so the right one is undone first
            if outer is None or (inner is not None and left > right):
                bound, left = left, inner[1]
            else:
                bound, right = right + 1, outer[0]


class PrefixTable:
    """The last tokens of all prefixes of one piece: exact appends, and edits filled anew near the edit."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.vocabulary.fill(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start to end; returns how many prefixes were filled anew.

        Once the last tokens of ``longest`` prefixes in a row agree with the old ones, all later ones do,
        for each depends on the bytes and last tokens of that many prefixes before it.
        """
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1]
        same = done = 0
        for at in range(start + 1, len(self.piece) + 1):
            if same >= self.vocabulary.longest:
                self.last.extend(old[at - shift :])
                break
            self.vocabulary.fill(self.piece[:at], self.last)
            done += 1
            same = same + 1 if at - shift > end and old[at - shift] == self.last[at] else 0
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder(dict):
    """Pieces of text to their ids as little-endian 32-bit integers; a dict so that known pieces cost one look-up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.words = [self.vocabulary.bytes_of.get(i) for i in range(self.vocabulary.size)]
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = PrefixTable(self.vocabulary, piece.encode("utf-8")).tokens()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, memoryview(packed).cast("I")))


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the token's bytes, then its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, lines))}


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and on demand ``ids`` and ``decoded``.

    ``vocabulary`` is a file that each worker can open (installed with the library that ships it).
    """
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            n, a, b, all_ids, back = [], [], [], [], []
            for text in batch.column(1):
                packed = coder.encode(text.as_py() or "")
                decoded = coder.decode(packed)
                n.append(len(packed) // 4)
                a.append(sha(packed))
                b.append(sha(decoded))
                if with_ids:
                    all_ids.append(packed)
                if with_decoded:
                    back.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *n], dtype=np.int64).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array(back, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(df.select(id_col, text_col), run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every whole document, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_documents(table(spark, sf_dir, "documents"), path, pattern, with_ids=False)
