"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item is a bag of lower-cased five-word shingles with a 64 bit
SimHash. Every window of a document that has as many words as an item, and at
least one of its shingles (without one the similarity is 0), is fingerprinted
at every offset; a document shorter than the item is one window. Fingerprints are cut into four blocks of 16 bits; two within
RADIUS differ in at most RADIUS // 4 bits of some block, and a table a block,
filled with every value in that reach of each item, gives all items in the
radius. Candidates are verified by exact weighted similarity: the sum of the
lesser over the sum of the greater multiplicities of the shingles of window and item.

The benchmark is cut into groups of ITEMS items, each with tables of a fixed
size, and every group runs over all documents, so its size is not bounded by memory. 23 bits of 64 lie four
standard deviations from the mean distance of sets at similarity 0.75.

Defined cases: null or empty texts and items match nothing; an item of fewer than five
words is one shingle of all its words; repeated items and rows give a row
each; an empty table on either side gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, bounded_batches, sparing
from .text import COEF, U64, chunks, mix, span_hashes, windows

K = 5
RADIUS, BLOCKS, WIDTH = 23, 4, 16
ITEMS = 512
NUM, DEN = 75, 100
_BITS = np.arange(64, dtype=U64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all five-word shingles in order; of the whole sequence where there are fewer words."""
    if 0 < len(words) < K:
        return mix((words * COEF[: len(words)]).sum(keepdims=True, dtype=U64) + U64(len(words)))
    return windows(words, np.array([0, len(words)]), K)[0]


def signs(h: np.ndarray) -> np.ndarray:
    return (((mix(h ^ U64(0x5851F42D4C957F2D))[:, None] >> _BITS) & U64(1)).astype(np.int32) << 1) - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(U64) << _BITS).sum(axis=-1, dtype=U64)


class Index:
    """A group of items, ready to be met by documents."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        """``items``: (number, hashes of its words)."""
        self.items = []
        for number, words in items:
            own = shingles(words)
            if len(own):
                values, counts = np.unique(own, return_counts=True)
                self.items.append((number, len(words), values, counts))
        self.prints = np.array([int(simhash((signs(v) * c[:, None]).sum(axis=0))) for _, _, v, c in self.items], U64)
        self.sizes = np.array([n for _, n, _, _ in self.items], np.int64)
        self.lanes = -(-len(self.items) // 64)
        self.tables = np.zeros((BLOCKS, 1 << WIDTH, max(1, self.lanes)), U64)
        reach = [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(WIDTH), r)]
        reach = np.array(reach, np.int64)
        for i, p in enumerate(self.prints.tolist()):
            for k in range(BLOCKS):
                self.tables[k, (p >> WIDTH * k & 0xFFFF) ^ reach, i // 64] |= U64(1 << i % 64)
        self.of_size = np.zeros((int(self.sizes.max()) + 1 if len(self.items) else 1, max(1, self.lanes)), U64)
        for i, n in enumerate(self.sizes.tolist()):
            self.of_size[n, i // 64] |= U64(1 << i % 64)
        pairs = defaultdict(set)
        for _, n, values, _ in self.items:
            for v in values.tolist():
                pairs[v].add(n)
        self.keys = np.array(sorted(pairs), U64)
        self.key_sizes = [sorted(pairs[k]) for k in self.keys.tolist()]
        self.short = sorted({n for n in self.sizes.tolist() if n < K})
        self.seen_short = {n: np.unique(np.concatenate([v for _, m, v, _ in self.items if m == n])) for n in self.short}

    def candidates(self, prints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(index of the print, index of the item) for all items of the size within the radius."""
        masks = np.zeros((len(prints), self.tables.shape[2]), U64)
        for k in range(BLOCKS):
            masks |= self.tables[k, ((prints >> U64(WIDTH * k)) & U64(0xFFFF)).astype(np.int64)]
        masks &= self.of_size[size]
        out = []
        for at, lane in zip(*np.nonzero(masks), strict=True):
            bits = int(masks[at, lane])
            while bits:
                i = (bits & -bits).bit_length() - 1 + 64 * int(lane)
                bits &= bits - 1
                if int(np.bitwise_count(prints[at] ^ self.prints[i])) <= RADIUS:
                    out.append((int(at), i))
        return out

    def meet(self, words: np.ndarray, h: np.ndarray, hits: np.ndarray, keys: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Item number -> (lesser sum, greater sum, first word) of the most similar window; ``hits``: the shingles that some item has, ``keys``: which of ``self.keys`` each is."""
        best: dict[int, tuple[int, int, int]] = {}
        by_size = defaultdict(list)
        for p, k in zip(hits.tolist(), keys.tolist(), strict=True):
            for n in self.key_sizes[k]:
                by_size[n].append(p)
        for n, places in by_size.items():
            span = n - K + 1
            last = len(words) - n
            if last < 0:  # the document is shorter than the item: one window, similar only with 0.75 of the item's shingles
                if DEN * len(h) >= NUM * span:
                    self._windows(h, np.array([0]), n, len(h), best)
                continue
            at = np.array(places)
            edge = np.zeros(last + 2, np.int64)
            np.add.at(edge, np.clip(at - span + 1, 0, last + 1), 1)
            np.add.at(edge, np.clip(at + 1, 0, last + 1), -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            for lo in range(0, len(starts), 2048):
                self._windows(h, starts[lo : lo + 2048], n, span, best)
        return best

    def _windows(self, h: np.ndarray, starts: np.ndarray, n: int, span: int, best: dict) -> None:
        # runs of neighbouring starts share their sums
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            lo, hi = int(run[0]), int(run[-1]) + span
            sums = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(signs(h[lo:hi]), axis=0, out=sums[1:])
            prints = simhash(sums[run - lo + span] - sums[run - lo])
            for at, i in self.candidates(prints, n):
                number, _, values, counts = self.items[i]
                start = int(run[at])
                own, times = np.unique(h[start : start + span], return_counts=True)
                _, x, y = np.intersect1d(own, values, assume_unique=True, return_indices=True)
                less = int(np.minimum(times[x], counts[y]).sum())
                more = int(counts.sum()) + span - less
                old = best.get(number)
                if DEN * less >= NUM * more and (old is None or less * old[1] > old[0] * more or less * old[1] == old[0] * more and start < old[2]):
                    best[number] = (less, more, start)

    def short_items(self, words: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Items of fewer than five words: one shingle, so similar means equal."""
        best = {}
        for n in self.short:
            if len(words) < n:
                continue
            w = len(words) - n + 1
            h = words[:w] * COEF[0]
            for j in range(1, n):
                h = h + words[j : w + j] * COEF[j]
            h = mix(h + U64(n))
            for number, m, values, _ in self.items:
                if m == n and len(at := np.flatnonzero(h == values[0])):
                    best[number] = (1, 1, int(at[0]))
        return best


def word_hashes(column) -> list[np.ndarray]:
    out = []
    for chunk in chunks(column):
        starts, ends, firsts = chunk.words()
        h = span_hashes(chunk.buf, starts, ends, lower=True)
        out += [h[firsts[i] : firsts[i + 1]] for i in range(len(chunk))]
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the most similar window of each document and item at 0.75 or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long"
    # items are read in groups of a fixed number; only one group is in the driver's hands at a time
    groups, part, out = benchmark.select("item_id", "text").toLocalIterator(), [], None
    for row in [*groups, None]:
        if row is not None:
            part.append(row)
        if part and (row is None or len(part) == ITEMS):
            hits = _group_hits(docs, part, schema)
            out, part = hits if out is None else out.unionByName(hits), []
    return out if out is not None else spark.createDataFrame([], schema)


def _group_hits(docs: DataFrame, part: list, schema: str) -> DataFrame:
    words = word_hashes(pa.array([r.text for r in part], pa.string()))
    shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in part], words))
    made: list[Index] = []

    def run(batches):
        ids, words = shared.value
        if not made:
            made.append(Index(list(enumerate(words))))
        index = made[0]
        for b in batches:
            rows, names = [], b.column(0)
            for chunk in chunks(b.column(1)):
                starts, ends, firsts = chunk.words()
                w = span_hashes(chunk.buf, starts, ends, lower=True)
                h, at = windows(w, firsts, K)
                if len(index.keys):
                    key = np.minimum(np.searchsorted(index.keys, h), len(index.keys) - 1)
                    hits = np.flatnonzero(index.keys[key] == h)
                else:
                    key, hits = h, np.empty(0, np.int64)
                docs_hit = np.unique(np.searchsorted(at, hits, "right") - 1).tolist()
                for d in docs_hit if not index.short else range(len(chunk)):
                    lo, hi = np.searchsorted(hits, [at[d], at[d + 1]])
                    own = hits[lo:hi]
                    best = index.meet(w[firsts[d] : firsts[d + 1]], h[at[d] : at[d + 1]], own - at[d], key[own])
                    if index.short:
                        best |= index.short_items(w[firsts[d] : firsts[d + 1]])
                    rows += [(chunk.first + d, ids[i], less / more, start, min(len(words[i]), int(firsts[d + 1] - firsts[d]))) for i, (less, more, start) in sorted(best.items())]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(sparing(run), schema)


#: Ids of contaminated documents are broadcast up to this count (8 bytes each), beyond it the documents are joined by shuffle.
FETCH = 1_000_000


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; a document goes as a whole, and rows of one id (or of none) share their fate."""
    hits = benchmark_hits(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    hits = Scratch(docs.sparkSession, "hits").keep(hits)
    few = F.broadcast(hits) if hits.count() <= FETCH else hits
    return docs.join(few, docs["doc_id"].eqNullSafe(hits["_hit"]), "left_anti")
