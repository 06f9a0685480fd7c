"""Quality classifier: a support vector machine on naive Bayes features.

A text's features are indicators of its n-grams: character trigrams (of
bytes), words, and how much of it repeats (the share of its three-word windows
seen before, in tenths), hashed into a fixed number of places. Each indicator
is scaled by its class log-count ratio, the vector by one over the root of the
number of features, and a linear hinge-loss model is fitted by dual coordinate
descent. A logistic curve fitted on rows left out of the descent turns margins
into scores.

Defined cases: a null or empty text has no features and scores the model's
intercept; repeated rows score alike; if the sample lacks a class, every score
is the share of label 1 in the sample (0.5 without any labelled row); other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_sample
from .storage import sparing
from .text import U64, chunks, mix, span_hashes, windows

BITS = 18
PLACES = (2 << BITS) + 16


def features(column) -> list[np.ndarray]:
    """The sorted distinct feature numbers of each text."""
    out = []
    for chunk in chunks(column):
        starts, ends, firsts = chunk.words()
        words = span_hashes(chunk.buf, starts, ends, lower=False)
        places = ((words >> U64(64 - BITS)).astype(np.int64)) + (1 << BITS)
        three, at = windows(words, firsts, 3)
        doc = np.repeat(np.arange(len(chunk)), np.diff(at))
        _, first = np.unique(mix(three + mix(doc.astype(U64))), return_index=True)
        total, fresh = np.bincount(doc, minlength=len(chunk)), np.bincount(doc[first], minlength=len(chunk))
        repeat = np.where(total > 0, 10 * (total - fresh) // np.maximum(total, 1), 11)
        wide = chunk.buf.astype(np.uint32)
        grams = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16) if len(wide) > 2 else wide[:0]
        grams = (grams * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32)
        seen = np.zeros(1 << BITS, bool)
        for i in range(len(chunk)):
            a, b = chunk.offsets[i], max(chunk.offsets[i + 1] - 2, chunk.offsets[i])
            if b - a > 3000:
                seen[grams[a:b]] = True
                own = np.flatnonzero(seen)
                seen[own] = False
            else:
                own = np.unique(grams[a:b])
            if chunk.offsets[i + 1] > chunk.offsets[i]:
                own = np.concatenate([own, np.unique(places[firsts[i] : firsts[i + 1]]), [(2 << BITS) + repeat[i]]])
            out.append(own.astype(np.int32))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, own: np.ndarray) -> float:
        return float(self.weights[own].sum() / np.sqrt(max(len(own), 1)) + self.bias)

    def score(self, column) -> np.ndarray:
        margins = np.array([self.margin(f) for f in features(column)])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the bias is one more feature of value 1."""
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> Model:
    """``y``: 0 or 1. Every fifth row is left for the curve."""
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2 or min(np.bincount(y)) < 5:
        share = (y.mean() if len(y) else 0.5).clip(0.01, 0.99) if len(y) else 0.5
        return Model(np.zeros(PLACES), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(seed).permutation(len(y))
    curve, main = order[::5], np.setdiff1d(order, order[::5])
    counts = np.ones((2, PLACES))
    for i in main:
        counts[y[i], rows[i]] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    per = np.bincount(y[main], minlength=2)
    weigh = cost * len(main) / (2 * np.maximum(per, 1))
    w, b = descend([rows[i] for i in main], 2 * y[main] - 1, ratio, weigh[y[main]], epochs, seed)
    model = Model(w * ratio, b, 1.0, 0.0)
    m = np.array([model.margin(rows[i]) for i in curve])
    model.slope, model.shift = platt(m, y[curve])
    return model


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g, d = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(d * margin * margin).sum() + 1e-3, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * margin).sum() + 1e-3 * a, g.sum()])
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(c)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, use=None) -> Model:
    """Fit on at most ``per_class`` labelled documents a class; features are made on the executors."""
    def encode(batches):
        for b in batches:
            rows = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "y", "f"])

    use = ~held_out() if use is None else use
    got = training_sample(docs, labels, label, per_class, use).select("doc_id", "text", "y").mapInArrow(sparing(encode), f"doc_id {dict(docs.dtypes)['doc_id']}, y int, f binary").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("y").to_pylist(), got.column("f").to_pylist(), strict=True))
    return fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.int64))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PLACES weights, whatever the corpus

    def run(batches):
        for b in batches:
            score = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows that score the threshold or more, with all their columns; nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at)) >= threshold))

    return docs.mapInArrow(sparing(run), docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 4000, threshold: float = 0.3) -> DataFrame:
    return classify(docs, train(docs, labels, "quality", per_class), threshold).withColumn("held_out", held_out()).select("doc_id", "held_out", F.col("score"), "predicted")
