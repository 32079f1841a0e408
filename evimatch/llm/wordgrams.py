"""Words and word windows of a whole Arrow batch of texts, as numpy arrays.

Spark decides which rows a task sees; inside the task these helpers turn the UTF-8 bytes of many texts into word spans,
64-bit word hashes and hashes of k consecutive words without a Python loop over words.  Texts are taken in pieces of half a
MB, so memory depends on the piece and on the longest single text, not on the batch.

A null text counts as empty; an empty text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _byte_table(word: np.ndarray) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[word] = True
    return table


_ALL = np.arange(256)
#: Bytes of words between white space: all but space and \t \n \v \f \r.
NOT_SPACE = _byte_table(_ALL[(_ALL != 0x20) & ((_ALL < 0x09) | (_ALL > 0x0D))])
#: Bytes of words made of ASCII letters, digits and all non-ASCII characters.
ALNUM = _byte_table(_ALL[((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | (_ALL >= 0x80)])
#: Lower-cases A-Z only and leaves every other byte alone.
_LOWER = _ALL.astype(np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a multiply-xorshift finaliser)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) * _U(_BASE)) | _U(1)


class _Powers:
    """Powers of a 64-bit odd base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 65_536)
            up, down = np.full(n, _U(self.base)), np.full(n, _U(self.inverse))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers(_BASE)


@dataclass
class Words:
    """The words of some consecutive texts.  Word i is data[starts[i]:ends[i]]; text d has words first[d] to first[d+1]-1."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        lo = 0
        while lo < len(self.starts):  # blocks of words, so that one very long text needs no arrays of its own size
            at = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + PIECE_BYTES, "right")))
            piece = self.data[at : self.ends[hi - 1]]
            up, down = _POWERS.upto(len(piece) + 1)
            total = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum((piece.astype(np.uint64) + _U(1)) * up[: len(piece)], out=total[1:])
            s = self.starts[lo:hi] - at
            out[lo:hi] = (total[self.ends[lo:hi] - at] - total[s]) * down[s]
            lo = hi
        return mix(out)

    def text_of_words(self) -> np.ndarray:
        """For each word the index of its text in this piece."""
        return np.repeat(np.arange(self.n_texts), self.counts)

    def windows(self, hashes: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text: (hash, index of the first word)."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        c = multipliers(k, seed)
        h = hashes[:n] * c[0]
        for j in range(1, k):
            h += hashes[j : n + j] * c[j]
        text = self.text_of_words()
        at = np.flatnonzero(text[:n] == text[k - 1 :])
        return mix(h[at]), at

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo to hi-1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True))


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, at, data = array.buffers()
    n = len(array)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, dtype=kind, count=n + 1, offset=array.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return offsets, raw


def pieces(array: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[Words]:
    """Cut a column of texts into pieces of about ``size`` bytes, at least one text each, and find their words."""
    offsets, raw = _bytes_of(array)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        off = offsets[row : end + 1] - offsets[row]
        data = raw[offsets[row] : offsets[end]]
        if lower:
            data = _LOWER[data]
        starts, ends = _spans(data, off, word)
        yield Words(row, data, off, starts, ends, np.searchsorted(starts, off))
        row = end


def _spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    inside = word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[:-1][np.diff(offsets) > 0]  # a word never runs over the edge of a text
    begins[at] = inside[at]
    at = offsets[1:][np.diff(offsets) > 0] - 1
    ends[at] = inside[at]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1
