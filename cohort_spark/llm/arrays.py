"""Numpy helpers that run inside tasks: words of an Arrow text column as
64-bit hashes, and hashes of runs of words.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes. A word is identified
by a 64-bit polynomial hash of its bytes (random 64-bit value per byte,
multiplied by powers of an odd base, finalised by a mixer). Everything is
computed for many texts at once on the Arrow buffers, in pieces of bounded
size cut at white space, so a text of any length is processed whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at once; temporaries take about 40 bytes for each.
PIECE = 1 << 20
#: Bytes of text handed on at once (a longer text is a chunk of its own).
CHUNK = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed))


_BYTE = splitmix(256, 11)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64; kept, grown by doubling."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(a)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset: a.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``size`` bytes each, at least one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a word never spans two texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    begins[1:] = ~word[:-1]
    inner = offsets[1:-1]
    begins[inner[inner < len(raw)]] = True
    ends = np.empty(len(raw), bool)
    ends[-1] = True
    ends[:-1] = ~word[1:]
    ends[inner[(inner > 0) & (inner <= len(raw))] - 1] = True
    return np.flatnonzero(begins & word), np.flatnonzero(ends & word) + 1


def _hash_piece(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    p, inv = powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, U64)
    total[0] = 0
    np.cumsum(table[raw] * p[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end byte of each word, and the first word of each
    text (n + 1 entries). ``lower`` treats A-Z as a-z."""
    starts, ends = word_bounds(raw, offsets)
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = _hash_piece(raw[a:b], starts[i:j] - a, ends[i:j] - a, table)
        i = j
    return out, starts, ends, np.searchsorted(starts, offsets)


class Runs:
    """Hashes of runs of consecutive words, by prefix sums over word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.p, self.inv = powers(len(hashes) + 1)
        self.total = np.empty(len(hashes) + 1, U64)
        self.total[0] = 0
        np.cumsum(hashes * self.p[: len(hashes)], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words begin..end-1, for each pair."""
        h = (self.total[end] - self.total[begin]) * self.inv[begin]
        return mix(h + (np.asarray(end) - np.asarray(begin)).astype(U64) * U64(0xA0761D6478BD642F))


def segment_of(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text, from the first words (n + 1 entries)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: sorted by (text, hash), and the
    first shingle of each text (n + 1 entries). A text of fewer than k words
    has its whole sequence as one; one without words has none."""
    n = np.diff(first)
    runs = Runs(hashes)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    where = np.repeat(np.arange(len(n)), count)
    begin = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    end = np.minimum(begin + k, first[1:][where])
    h = runs.of(begin, end)
    at = np.searchsorted(where, np.arange(len(n) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (where[1:] != where[:-1])
    h, where = h[keep], where[keep]
    return h, np.searchsorted(where, np.arange(len(n) + 1))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed long."""
    return np.ascontiguousarray(x).view(np.int64)
