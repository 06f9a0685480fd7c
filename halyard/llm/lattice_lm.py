"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary span a lattice over each word; a word's
spelling has the sum over all its segmentations of the product of the pieces'
probabilities, by forward recursion in log space. The vocabulary stays as it
is. Its scores start the piece probabilities; expected piece counts over all
distinct words of the training texts (forward and backward) then re-estimate
them, with single bytes as pieces of last resort, so that every text has a
probability, and an end of the word as a piece of its own.

One more arc spans a word as a whole, with its discounted relative frequency
in the training texts; the discounts, from the counts of counts, leave the
mass that the spellings share. The probability of a word is the sum over all
paths. A text is the sequence of its lower-cased words and an end; white space
between words is not modelled.

All these probabilities exist once for each class of training texts: the
languages (values of ``class_col``) with the most training rows, at most
CLASSES of them, and the other rows together. A text's class is not read when it is
scored: its probability is the sum over classes of the class's share of the
training rows times the probability of the text in it.

As a segmentation never crosses words, each distinct word is scored once. The
commonest words, some HOT of them, are broadcast; the others meet the
documents' counts in a join on their hashes.

Defined cases: null and empty texts are an end alone; a null class is a class
like others; with no training text
every count is 0, the base of each token is ``log10(1 / 1)``, pieces keep
their starting values and the end of a text has that of a word's; repeated rows are scored one by one; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out
from .storage import Scratch, bounded_batches, highest
from .text import LOWER, PIECE, U64, Chunk, chunks, span_hashes, _BASE, _BASE_INV, _BYTE

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HOT = 1 << 18
CLASSES = 8
ROUNDS = 2
MARK = "▁"
SLOTS = 1 << 20


def read_vocabulary(path: str) -> list[tuple[bytes, float]]:
    """(piece, log weight) of pieces that lie within one word; the mark of a word's start is a space. Ranks, as merge vocabularies score, become a Zipf weight."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or MARK in piece[1:]:
            continue
        out[piece.replace(MARK, " ").encode()] = model.get_score(i)
    if min(out.values(), default=0) < -100:
        out = {p: -math.log(1 - s) for p, s in out.items()}
    return sorted(out.items())


class Lattice:
    """Pieces 0.. are the vocabulary's, then 256 bytes, then the end; ``log_p`` has a column a class."""

    def __init__(self, pieces: list[tuple[bytes, float]], log_p: np.ndarray | None = None):
        self.n = len(pieces)
        self.longest = max((len(p) for p, _ in pieces), default=1)
        if log_p is None:
            known = np.array([s for _, s in pieces] or [0.0])
            log_p = np.concatenate([known, np.full(257, known.min() - math.log(10))])[:, None]
            log_p -= np.logaddexp.reduce(log_p)
        self.log_p = log_p
        self.key, self.piece = np.zeros(SLOTS, U64), np.full(SLOTS, -1, np.int32)
        for i, (p, _) in enumerate(pieces):
            h = self.hash(p)
            at = h >> 44
            while self.piece[at] >= 0:
                at = (at + 1) % SLOTS
            self.key[at], self.piece[at] = h, i

    @staticmethod
    def hash(piece: bytes) -> int:
        h = sum(int(_BYTE[c]) * pow(_BASE, k, 2**64) for k, c in enumerate(piece)) % 2**64
        return h * 0x9FB21C651E98DF25 % 2**64

    def find(self, h: np.ndarray) -> np.ndarray:
        h = h * U64(0x9FB21C651E98DF25)
        at = (h >> U64(44)).astype(np.int64)
        out = np.where(self.key[at] == h, self.piece[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.piece[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % SLOTS
            hit = self.key[at[open_]] == h[open_]
            out[open_[hit]] = self.piece[at[open_[hit]]]
            open_ = open_[~hit & (self.piece[at[open_]] >= 0)]
        return out

    def edges(self, buf: np.ndarray, sizes: np.ndarray):
        """(from node, to node, piece, offset of from, length), by bytes; a word of L bytes has L + 1 nodes."""
        power, inverse = _powers_to(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
        word = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        left = ends[word] - np.arange(len(buf))
        offset = sizes[word] - left
        place, length, piece = [np.arange(len(buf))], [np.ones(len(buf), np.int64)], [self.n + buf.astype(np.int64)]
        p = np.arange(len(buf))
        for m in range(1, self.longest + 1):
            p = p[left[p] >= m]
            got = self.find((sums[p + m] - sums[p]) * inverse[p])
            hit = got >= 0
            place.append(p[hit])
            length.append(np.full(hit.sum(), m))
            piece.append(got[hit])
        p, m, k = np.concatenate(place), np.concatenate(length), np.concatenate(piece)
        return p + word[p], p + m + word[p], k, offset[p], m, word[p]

    def forward(self, buf: np.ndarray, sizes: np.ndarray, of: slice = slice(None)):
        """Log probabilities of all nodes and of all words, a column for each of the classes in ``of``."""
        a, b, k, offset, m, word = self.edges(buf, sizes)
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        weight = self.log_p[k, of]
        alpha = np.full((int(sizes.sum()) + len(sizes), weight.shape[1]), -np.inf)
        alpha[first] = 0
        byte = k >= self.n
        for lo, hi, order in _steps((offset + m) * 128 + 2 * m + byte):
            e = order[lo:hi]
            alpha[b[e]] = np.logaddexp(alpha[b[e]], alpha[a[e]] + weight[e])
        return alpha, alpha[first + sizes], (a, b, k, offset, m, word, byte, weight, first)

    def expect(self, buf: np.ndarray, sizes: np.ndarray, of: int = 0) -> np.ndarray:
        """Expected uses of each piece in a class, each word once."""
        alpha, total, (a, b, k, offset, m, word, byte, weight, first) = self.forward(buf, sizes, slice(of, of + 1))
        alpha, total, weight = alpha[:, 0], total[:, 0], weight[:, 0]
        beta = np.full(len(alpha), -np.inf)
        beta[first + sizes] = 0
        for lo, hi, order in reversed(list(_steps(offset * 128 + 2 * m + byte))):
            e = order[lo:hi]
            beta[a[e]] = np.logaddexp(beta[a[e]], beta[b[e]] + weight[e])
        share = np.exp(alpha[a] + weight + beta[b] - total[word])
        return np.bincount(k, share, minlength=self.n + 257)


_cache: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    if not _cache or len(_cache[0]) < n:
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(max(n, 1 << 19), base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _cache[:] = made
    return _cache


def _steps(key: np.ndarray):
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], [order] * (len(cuts) + 1), strict=True) if len(key) else ()


def _word_blocks(column, size: int = 1 << 17):
    """(first word, bytes with a space before each word, sizes) of at most ``size`` bytes, one word at least; short words and long ones apart."""
    words = column.to_pylist()
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        to, n = at, 0
        while to < len(order) and (to == at or n + len(words[order[to]]) * 4 < size * 2 and n < size):
            n += len(words[order[to]].encode()) + 1
            to += 1
        rows = order[at:to]
        data = [b" " + words[i].encode() for i in rows]
        yield np.array(rows), np.frombuffer(b"".join(data), np.uint8), np.array([len(x) for x in data], np.int64)
        at = to


def _count(n_classes: int):
    """(word, c0, c1, ..., a): of each chunk's words, how often in the training texts of each class, and in all texts."""
    def run(batches):
        for b in batches:
            kinds = b.column(1).to_numpy() + 1  # 0: not a training text
            for chunk in chunks(b.column(0), 8 * PIECE):
                starts, ends, firsts = chunk.words()
                h = span_hashes(chunk.buf, starts, ends, lower=True)
                kind = np.repeat(kinds[chunk.first : chunk.first + len(chunk)], np.diff(firsts))
                _, first, which = np.unique(h, return_index=True, return_inverse=True)
                low = LOWER[chunk.buf].tobytes()
                words = [low[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                c = np.bincount(which * (n_classes + 1) + kind, minlength=len(first) * (n_classes + 1)).reshape(len(first), n_classes + 1)
                columns = [pa.array(words, pa.binary()).cast(pa.string()), *(pa.array(c[:, k + 1]) for k in range(n_classes)), pa.array(c.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", *_class_columns(n_classes), "a"])
    return run


def _class_columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def word_hash(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return span_hashes(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, lower=True)


def _classes(docs: DataFrame, class_col: str | None):
    """A column with the number of a row's class, and how many training rows each class has."""
    if class_col is None:
        return F.lit(0), [docs.where(~F.col("held_out")).count()]
    by = docs.where(~F.col("held_out")).groupBy(class_col).count()
    named = by.orderBy(F.desc("count"), F.col(class_col).asc_nulls_last()).limit(CLASSES).collect()
    rows = [r["count"] for r in named]
    rest = (by.agg(F.sum("count")).first()[0] or 0) - sum(rows)
    number = F.lit(len(rows) if rest else 0)
    for k, r in reversed(list(enumerate(named))):
        number = F.when(F.col(class_col).eqNullSafe(F.lit(r[class_col])), k).otherwise(number)
    return number, rows + [rest] * (rest > 0) or [0]


def lattice_scores(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, fold: int = 7, held: int = 2, rounds: int = ROUNDS, class_col: str | None = "lang") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lattice")
    docs = docs.select("doc_id", "text", *([class_col] if class_col else []), held_out(fold=fold, rest=held).alias("held_out"))
    pieces = read_vocabulary(vocabulary)
    number, texts = _classes(docs, class_col)
    n_classes = len(texts)
    own = _class_columns(n_classes)
    kind = F.when(F.col("held_out"), -1).otherwise(number).cast("long")
    counted = docs.select("text", kind.alias("kind")).mapInArrow(_count(n_classes), f"word string, {', '.join(f'{c} long' for c in own)}, a long")
    words = scratch.keep(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in [*own, "a"])))
    every = sum((F.col(c) for c in own[1:]), F.col(own[0]))
    seen = words.agg(F.count_if(every > 0), *(x for c in own for x in (F.coalesce(F.sum(c), F.lit(0)), F.count_if(F.col(c) > 0), *(F.count_if(F.col(c) == k) for k in (1, 2, 3, 4))))).first()
    per_class = [seen[1 + 6 * k : 7 + 6 * k] for k in range(n_classes)]
    totals = [x[0] + t for x, t in zip(per_class, texts, strict=True)]
    total, distinct = sum(totals), seen[0] + (sum(texts) > 0)
    cuts, spreads = zip(*(discounts(x[2:], x[1] + (t > 0), n) for x, t, n in zip(per_class, texts, totals, strict=True)), strict=True)
    log_p = np.repeat(Lattice(pieces).log_p, n_classes, axis=1)
    for _ in range(rounds if seen[0] else 0):
        log_p = _reestimate(spark, words, pieces, log_p)
    shared = spark.sparkContext.broadcast((pieces, log_p))  # as large as the vocabulary
    made: list[Lattice] = []

    def score(batches):
        if not made:
            made.append(Lattice(*shared.value))
        for b in batches:
            out = np.zeros((b.num_rows, n_classes))
            for rows, buf, sizes in _word_blocks(b.column(0)):
                out[rows] = made[0].forward(buf, sizes)[1] + made[0].log_p[-1]
            c = np.stack([b.column(name).to_numpy() for name in own], axis=1)
            cut = np.stack([np.array(cuts[k])[np.minimum(c[:, k], 3)] for k in range(n_classes)], axis=1)
            with np.errstate(divide="ignore"):
                whole = np.log((c - cut) / np.maximum(totals, 1))
                out = np.logaddexp(whole, np.log(spreads) + out) / math.log(10)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * n_classes), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(word_hash(b.column(0).to_pylist()).view(np.int64)), pa.array(c.sum(axis=1)), b.column("a"), lists], names=["h", "c", "a", "lp"])

    scored = scratch.keep(words.mapInArrow(score, "h long, c long, a long, lp array<double>"))
    scratch.drop(words)
    common = highest(scored, "a", "h", HOT).select("h", "c", "lp").toArrow().sort_by("h").combine_chunks()
    lp = pa.chunked_array(common.column("lp")).combine_chunks().flatten().to_numpy().reshape(-1, n_classes)
    hot = spark.sparkContext.broadcast((common.column("h").to_numpy(), common.column("c").to_numpy(), lp))  # some HOT rows
    size = float(total + distinct + 1)

    def meet(batches):
        keys, c, lp = hot.value
        tables = np.column_stack([c > 0, np.log10((c + 1) / size), lp])
        for b in batches:
            for chunk in chunks(b.column(1)):
                starts, ends, firsts = chunk.words()
                h = span_hashes(chunk.buf, starts, ends, lower=True).view(np.int64)
                n = len(chunk)
                doc = np.repeat(np.arange(n), np.diff(firsts))
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                d, a = doc[found], at[found]
                sums = np.column_stack([np.diff(firsts), *(np.bincount(d, x[a], minlength=n) for x in tables.T)]).astype(float)
                rest_doc, rest = doc[~found], h[~found]
                order = np.lexsort((rest, rest_doc))
                rest_doc, rest = rest_doc[order], rest[order]
                new = np.ones(len(rest), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])
                edge = np.flatnonzero(new)
                k = np.diff(np.append(edge, len(rest)))
                row = b.column(0).slice(chunk.first, n).to_numpy()
                m, width = len(edge), sums.shape[1]
                # a row a document with its sums over common words (its key is of no word), and one a word that isn't common
                offsets = np.minimum(np.arange(n + m + 1), n) * width
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums.ravel()), mask=pa.array(np.arange(n + m) >= n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([row, row[rest_doc[edge]]])), pa.array(np.concatenate([row * 0x5DEECE66D ^ 0x2545F4914F6CDD1D, rest[edge]])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), k])), lists], names=["r", "h", "k", "sums"])

    rows = docs.withColumn("r", F.monotonically_increasing_id())
    met = rows.select("r", "text").mapInArrow(meet, "r long, h long, k long, sums array<double>")
    rest = scored.select("h", F.col("c").alias("wc"), F.col("lp").alias("wlp"))
    part = lambda i, other: F.sum(F.coalesce(F.get("sums", F.lit(i)), F.col("k") * other, F.lit(0.0)))
    sums = met.join(rest, "h", "left").groupBy("r").agg(
        part(0, F.lit(0.0)).alias("n"), part(1, (F.col("wc") > 0).cast("double")).alias("known"), part(2, F.log10((F.col("wc") + 1) / F.lit(size))).alias("base"),
        *(part(3 + k, F.get("wlp", F.lit(k))).alias(f"lp{k}") for k in range(n_classes)))
    n_texts = sum(texts)
    end_base = math.log10((n_texts + 1) / size)
    ends = [math.log10((t - cuts[k][min(t, 3)]) / totals[k] * t / n_texts) if t else log_p[-1, k] / math.log(10) for k, t in enumerate(texts)]
    by_class = F.array(*(F.col(f"lp{k}") + ends[k] for k in range(n_classes)))
    best = F.array_max("by_class")
    score_of = best + F.log10(F.aggregate("by_class", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - best)))
    return (rows.select("r", "doc_id", "held_out").join(sums, "r").withColumn("by_class", by_class).select(
        "doc_id", "held_out", (F.col("n") + 1).cast("long").alias("n_tokens"), (F.col("known") + int(n_texts > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"), score_of.alias("score")))


def discounts(n: tuple[int, ...], distinct: int, total: int) -> tuple[list[float], float]:
    """What is taken off counts 0, 1, 2 and 3 or more, from the numbers of words seen 1 to 4 times; the share of all that it frees."""
    if not total:
        return [0.0] * 4, 1.0
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    cut = [0.0] + [min(max(k - (k + 1) * y * after / now, 0.05), k - 0.05) for k, now, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    freed = cut[1] * n[0] + cut[2] * n[1] + cut[3] * max(distinct - n[0] - n[1], 0)
    return cut, freed / total


def _reestimate(spark, words: DataFrame, pieces, log_p: np.ndarray) -> np.ndarray:
    """Piece log probabilities from expected counts over all distinct training words of each class; what comes back is a row a piece and class and no more."""
    shared = spark.sparkContext.broadcast((pieces, log_p))
    n_classes = log_p.shape[1]

    def expect(batches):
        lattice, total = None, None
        for b in batches:
            if lattice is None:
                lattice = Lattice(*shared.value)
                total = np.zeros((lattice.n + 257, n_classes))
            for k in range(n_classes):
                own = b.column(0).filter(pa.array(b.column(k + 1).to_numpy() > 0))
                for _, buf, sizes in _word_blocks(own):
                    total[:, k] += lattice.expect(buf, sizes, k)
                    total[-1, k] += len(sizes)
        if total is not None:
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], names=["piece", "class", "uses"])

    got = words.select("word", *_class_columns(n_classes)).mapInArrow(expect, "piece long, class long, uses double").groupBy("piece", "class").agg(F.sum("uses").alias("uses")).orderBy("piece", "class").toArrow()
    uses = np.full(log_p.shape, 1e-3)
    uses[got.column("piece").to_numpy(), got.column("class").to_numpy()] += got.column("uses").to_numpy()
    return np.log(uses / uses.sum(axis=0))
