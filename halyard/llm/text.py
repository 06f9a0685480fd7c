"""Vectorised word and shingle hashing over Arrow text columns.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` over code points. Hashes are 64 bit: a
polynomial over a random value per byte, then mixed. All functions take whole
texts; a long text is hashed piece by piece, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
COEF = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bit values that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and don't overlap."""
    out, at, table = np.empty(len(starts), U64), 0, _BYTE_LOWER if lower else _BYTE
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = int(ends[to - 1])
        power, inverse = _power(hi - lo)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[buf[lo:hi]] * power[: hi - lo], out=sums[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[b] - sums[a]) * inverse[a] + b.astype(U64) - a.astype(U64)
        at = to
    return mix(out)


@dataclass
class Chunk:
    """Some whole documents: their bytes, and where each begins and ends."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in ``buf``; the index of each document's first word, with the total last."""
        return runs(~SPACE[self.buf], self.offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places, none across a document's edge; the index of each document's first run, with the total last."""
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    stops[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if where else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, size: int = 2 * PIECE) -> Iterator[Chunk]:
    """The documents of a column, some at a time, of ``size`` bytes at most but one document at least."""
    buf, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Chunk(at, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every ``k`` words in a row of the same document, and the index of each document's first; a document with fewer words has none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.zeros(len(firsts), np.int64)
    h = words[:n] * COEF[0]
    for j in range(1, k):
        h = h + words[j : n + j] * COEF[j]
    counts = np.diff(firsts)
    inside = np.ones(n, bool)
    for j in range(1, k):
        cut = firsts[1:-1] - j
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return mix(h[inside] + U64(k)), np.concatenate([[0], np.cumsum(np.maximum(counts - k + 1, 0))])


def shingle_sets(chunk: Chunk, k: int = 5) -> Iterator[np.ndarray]:
    """Each document's set of lower-cased ``k``-word shingles as sorted hashes.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    starts, ends, firsts = chunk.words()
    words = span_hashes(chunk.buf, starts, ends, lower=True)
    h, at = windows(words, firsts, k)
    for i in range(len(chunk)):
        a, b = firsts[i], firsts[i + 1]
        if b - a >= k:
            yield np.unique(h[at[i] : at[i + 1]])
        elif b > a:
            yield mix((words[a:b] * COEF[: b - a]).sum(keepdims=True, dtype=U64) + U64(b - a))
        else:
            yield np.empty(0, U64)
