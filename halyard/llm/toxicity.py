"""Toxicity: Levenshtein automata over a learnt lexicon, and scores in context.

The lexicon comes from labelled texts: words, and beginnings of words, that
stand far more often in toxic texts than in others. Its trie is intersected
with the automaton of edit distance one (for all terms of five letters or more,
words and beginnings alike) and made deterministic once, so that all words of a chunk
run through one table, letter by letter, until they can no longer match. A
letter is a code point, and case is folded code point by code point, in learning as in scanning.

A word is a run without white space, less the marks around it; where it doesn't match,
its runs of letters and digits are tried. A hit counts as quoted if quotation
marks enclose it within its window of words or a word of reporting stands there, else as abuse.
Counts of exact, stem, misspelt, misspelt stem and quoted hits and their density weigh in a logistic model fitted on the same
sample.

Bounds that are parameters: ``per_class`` labelled documents a class to learn from,
and the ``limit`` terms with the highest log odds in the lexicon.

Defined cases: a null or empty text has no hits and scores the intercept; if
the sample lacks a class, scores are the share of label 1 (0.5 without rows);
repeated rows score alike; columns other than doc_id and text are not read;
bytes that are no UTF-8 count as marks.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_sample
from .text import SPACE, Chunk, chunks, runs

EXACT, STEM, FUZZY, NEAR_STEM = 1, 2, 4, 8
KINDS = (EXACT, STEM, FUZZY, NEAR_STEM)
#: Words that report what somebody said.
REPORTING = {"said", "says", "wrote", "writes", "called", "quoted", "quote", "quotes", "according", "reported", "claimed", "dijo", "dit", "sagte"}
SPAN = 8
#: Code points with case or a category of their own lie below this; those above are letters.
PLANES = 0x20000
FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(PLANES)], np.uint32)
LETTER = np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(PLANES)])


class Letters:
    """A chunk's documents as folded code points, with its words and their places in them."""

    def __init__(self, chunk: Chunk):
        data = chunk.buf.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)]
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        below = np.minimum(points, PLANES - 1)
        self.letter = LETTER[below] | (points >= PLANES)
        self.points = np.where(points < PLANES, FOLD[below], points)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.starts, self.ends, self.firsts = runs((points > 255) | ~SPACE[np.minimum(points, 255)], self.offsets)

    def trimmed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words without the marks around them; a word of marks is empty."""
        at = np.flatnonzero(self.letter)
        lo, hi = np.searchsorted(at, self.starts), np.searchsorted(at, self.ends)
        full = hi > lo
        a, b = self.starts.copy(), self.starts.copy()
        a[full], b[full] = at[lo[full]], at[hi[full] - 1] + 1
        return a, b

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and words of the runs of letters and digits."""
        a, b, _ = runs(self.letter, self.offsets)
        return a, b, np.searchsorted(self.starts, a, "right") - 1


def _vocabulary(batches):
    """(y, terms): each text's distinct words of four letters or more and their beginnings (marked with a star)."""
    for b in batches:
        out = []
        for chunk in chunks(b.column(0)):
            at = Letters(chunk)
            a, b_, word = at.pieces()
            text = at.points.astype("<u4").tobytes().decode("utf-32-le", "replace")
            doc = np.searchsorted(at.firsts, word, "right") - 1
            cut = np.searchsorted(doc, np.arange(len(chunk) + 1))
            for i in range(len(chunk)):
                words = {text[x:y] for x, y in zip(a[cut[i] : cut[i + 1]].tolist(), b_[cut[i] : cut[i + 1]].tolist(), strict=True) if y - x >= 4}
                out.append(sorted(words | {w[:n] + "*" for w in words for n in range(4, min(len(w), 8) + 1)}))
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.string()))], names=["y", "terms"])


def lexicon(sample: DataFrame, min_docs: int = 5, min_log_odds: float = 3.0, limit: int = 1024) -> list[tuple[str, bool, float]]:
    """(term, whether it is the beginning of a word, log odds) learnt from (text, y); at most ``limit`` terms.

    A beginning of four letters gets no edits, so the longest beginning that nine
    in ten of its texts have comes with it. Words under a beginning that has edits are left out.
    """
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    odds = F.log((F.col("pos") + 0.5) / (totals[1] + 1.0) / ((F.col("neg") + 0.5) / (totals[0] + 1.0)))
    terms = sample.select("text", "y").mapInArrow(_vocabulary, "y int, terms array<string>").select("y", F.explode("terms").alias("term"))
    found = (terms.groupBy("term").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
             .where(F.col("pos") >= min_docs).withColumn("odds", odds).where(F.col("odds") >= min_log_odds)
             .orderBy(F.desc("odds"), "term").limit(20 * limit).collect())
    out: dict[tuple[str, bool], float] = {}
    begins = sorted((r for r in found if r.term.endswith("*")), key=lambda r: (len(r.term), r.term))
    best, stems = max((r.odds for r in found), default=0), set()
    for r in begins:
        stem = r.term[:-1]
        if r.odds >= max(min_log_odds + 1, best - 3) and not any(stem.startswith(s) for s in stems):
            stems.add(stem)
            out[stem, True] = r.odds
            longer = [x for x in begins if x.term.startswith(stem) and len(x.term) > len(r.term) and 10 * x.pos >= 9 * r.pos]
            if longer:
                out[longer[-1].term[:-1], True] = longer[-1].odds
    edited = tuple(s for s, _ in out if len(s) >= MIN_EDITED)
    for r in found:
        if not r.term.endswith("*") and not r.term.startswith(edited):
            out[r.term, False] = r.odds
    ranked = sorted(out.items(), key=lambda x: (-x[1], x[0]))[:limit]
    return [(t, s, o) for (t, s), o in ranked]


MIN_EDITED = 5
_FOUND = (-1, 1)  # a misspelt stem that has been read


@dataclass
class Automaton:
    """``table[state, class]`` is the next state, ``flags[state]`` what a word that ends there is; state 0 is dead, 1 the start, 2 a stem, 3 nothing but a misspelt stem."""

    table: np.ndarray
    flags: np.ndarray
    classes: np.ndarray

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        state, flags, sizes = np.ones(len(starts), np.int32), np.zeros(len(starts), np.uint8), ends - starts
        live, k = np.flatnonzero(sizes > 0), 0
        while len(live):
            now = self.table[state[live], self.classes[np.minimum(points[starts[live] + k], PLANES - 1)]]
            k += 1
            state[live] = now
            # what a word that ends here is; a stem that is found stays found
            over = (sizes[live] == k) | (now == 2) | (now == 3)
            flags[live[over]] = self.flags[now[over]]
            live = live[~over & (now > 0)]
        return flags


def compile_automaton(terms: list[tuple[str, bool, float]]) -> Automaton:
    """The lexicon's trie with the Levenshtein automaton, by subsets of (trie node, edits)."""
    children: list[dict[str, int]] = [{}]
    whole, stem, near = {0: set(), 1: set()}, {0: set(), 1: set()}, set()
    for term, is_stem, _ in terms:
        path = [0]
        for c in term:
            path.append(children[path[-1]].setdefault(c, len(children)))
            if path[-1] == len(children):
                children.append({})
        for e in (0, 1) if len(term) >= MIN_EDITED else (0,):
            (stem if is_stem else whole)[e].add(path[-1])
        if len(term) >= MIN_EDITED:
            near.update(path)
    letters = sorted({c for kids in children for c in kids})
    number_of = {c: i + 1 for i, c in enumerate(letters)}
    classes = np.zeros(PLANES, np.uint16)
    for c, i in number_of.items():
        if ord(c) < PLANES - 1:
            classes[ord(c)] = i

    def close(states: set[tuple[int, int]]) -> frozenset:
        out = set(states)
        for node, e in states:
            if e == 0 and node in near:
                out.update((kid, 1) for kid in children[node].values() if kid in near)  # a letter left out
        if any(e == 1 and n in stem[1] for n, e in out):
            out.add(_FOUND)
        return frozenset(s for s in out if s == _FOUND or not (s[1] == 1 and (s[0], 0) in out))

    def step(states: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, e in states:
            if (node, e) == _FOUND:
                out.add(_FOUND)
                continue
            kid = children[node].get(c) if c is not None else None
            if kid is not None and (e == 0 or kid in near):
                out.add((kid, e))
            if e == 0 and node in near:
                out.add((node, 1))  # a letter too many
                out.update((k, 1) for k in children[node].values() if k in near)  # another letter
        return close(out)

    begin, number, rows, flags, todo = close({(0, 0)}), {}, {}, {0: 0, 2: STEM, 3: NEAR_STEM}, []

    def place(states: frozenset) -> int:
        if not states:
            return 0
        if any(e == 0 and n in stem[0] for n, e in states):
            return 2
        if states == {_FOUND}:
            return 3
        if states not in number:
            number[states] = at = len(number) + 4 if number else 1
            todo.append(states)
            flags[at] = EXACT if any(e == 0 and n in whole[0] for n, e in states) else FUZZY if any(e == 1 and n in whole[1] for n, e in states) else NEAR_STEM if _FOUND in states else 0
        return number[states]

    place(begin)
    while todo:
        now = todo.pop()
        row = [place(step(now, None))] * (len(letters) + 1)  # other letters all do the same
        for c in {c for node, _ in now if node >= 0 for c in children[node]}:
            row[number_of[c]] = place(step(now, c))
        rows[number[now]] = row
    n = max(flags) + 1
    fixed = {2: [2] * (len(letters) + 1), 3: [3] * (len(letters) + 1)}
    dead = [0] * (len(letters) + 1)
    return Automaton(np.array([rows.get(i, fixed.get(i, dead)) for i in range(n)], np.int32), np.array([flags.get(i, 0) for i in range(n)], np.uint8), classes)


def word_flags(at: Letters, auto: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each word is, and where it begins and ends without marks."""
    a, b = at.trimmed()
    flags = auto.match(at.points, a, b)
    x, y, word = at.pieces()
    open_ = (np.bincount(word, minlength=len(flags))[word] > 1) & (flags[word] == 0) if len(word) else np.zeros(0, bool)
    inner = auto.match(at.points, x[open_], y[open_])
    found = np.full(len(flags), 255, np.uint8)
    np.minimum.at(found, word[open_][inner > 0], inner[inner > 0])
    return np.where(found < 255, found, flags), a, b


def hit_features(column, auto: Automaton) -> np.ndarray:
    """Per text, the logs of one more than: hits of each kind as abuse, quoted hits, most hits within a window; and hits a hundred words."""
    parts, width = [], len(KINDS)
    for chunk in chunks(column):
        at = Letters(chunk)
        flags, a, b = word_flags(at, auto)
        hits, firsts = np.flatnonzero(flags), at.firsts
        doc = np.searchsorted(firsts, hits, "right") - 1
        out = np.zeros((len(chunk), FEATURES))
        quoted = np.zeros(len(hits), bool)
        for k, h in enumerate(hits.tolist()):
            lo, hi = max(h - SPAN, int(firsts[doc[k]])), min(h + SPAN + 1, int(firsts[doc[k] + 1]))
            before, after = at.text[at.starts[lo] : a[h]], at.text[b[h] : at.ends[hi - 1]]
            marks, closing = [before.count(q) for q in '"“«„'], [after.count(q) for q in '"”»“']
            inside = any(x % 2 if i == 0 else x for i, x in enumerate(marks)) and any(closing)
            quoted[k] = inside or bool(REPORTING & {w.strip(".,:;!?\"'") for w in before.lower().split()[-3:]})
        for column_no, kind in enumerate(KINDS):
            out[:, column_no] = np.bincount(doc[(flags[hits] == kind) & ~quoted], minlength=len(chunk))
        out[:, width] = np.bincount(doc[quoted], minlength=len(chunk))
        near = np.searchsorted(hits, hits + 10, "right") - np.arange(len(hits))
        for d in range(1, 11):  # hits of the next document don't count
            if len(hits) > d:
                near[:-d] -= (doc[d:] != doc[:-d]) & (hits[d:] - hits[:-d] <= 10)
        np.maximum.at(out[:, width + 1], doc, near)
        out[:, : width + 2] = np.log1p(out[:, : width + 2])
        out[:, width + 2] = np.minimum(100 * np.bincount(doc, minlength=len(chunk)) / np.maximum(np.diff(firsts), 1), 100) / 10
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


FEATURES = len(KINDS) + 3


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(x.shape[1]), ridge * len(x) / 100 * np.eye(x.shape[1])
    hold[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold, x.T @ (p - y) + hold @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray
    terms: list

    def score(self, column) -> np.ndarray:
        x = hit_features(column, self.automaton)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, use=None) -> Model:
    """Learn the lexicon and the weights from at most ``per_class`` labelled documents a class."""
    use = ~held_out() if use is None else use
    sample = training_sample(docs, labels, label, per_class, use).select("doc_id", "text", "y").persist()
    try:
        terms = lexicon(sample)
        auto = compile_automaton(terms)

        def encode(batches):
            for b in batches:
                x = hit_features(b.column(1), auto)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        rows = sorted((r.doc_id, r.y, r.x) for r in sample.mapInArrow(encode, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x array<double>").collect())
    finally:
        sample.unpersist()
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        share = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        return Model(auto, np.array([0.0] * FEATURES + [np.log(share / (1 - share))]), terms)
    # the sample has as many of the rare class as the bound allows; the intercept is of the sample
    return Model(auto, logistic(np.array([r[2] for r in rows]), y), terms)


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred terms, whatever the corpus

    def run(batches):
        for b in batches:
            score = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = 4000, threshold: float = 0.5) -> DataFrame:
    return classify(docs, train(docs, labels, "toxic", per_class), threshold).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
