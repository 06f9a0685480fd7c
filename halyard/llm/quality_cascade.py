"""Quality rules as a short-circuit cascade.

Every rule reads one or more measures of a text. On a bounded sample of
documents the cascade times each measure and counts what each rule rejects,
and then runs the rules by rejections per second, highest first. A document
that one rule rejects is not measured for the rules behind it. The order
changes only the time: a document is kept if no rule rejects it.

Defined cases: a null text is an empty one (no words, so ``few_words`` rejects
it); repeated rows are judged one by one and get equal results; an empty table
gives an empty result; columns of the input other than the id and the text are
not read, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, sparing
from .text import SPACE, U64, Chunk, chunks, mix, span_hashes, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8


def _per_doc(chunk: Chunk, flags: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]


class Texts:
    """A chunk with the parts that several measures share."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self._words = None

    @property
    def words(self):
        if self._words is None:
            self._words = self.chunk.words()
        return self._words


def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.words[2])


def word_chars(t: Texts) -> np.ndarray:
    buf = t.chunk.buf
    return _per_doc(t.chunk, ~SPACE[buf] & ((buf & 0xC0) != 0x80))


def n_symbols(t: Texts) -> np.ndarray:
    return _per_doc(t.chunk, SYMBOLS[t.chunk.buf])


def n_upper(t: Texts) -> np.ndarray:
    return _per_doc(t.chunk, (t.chunk.buf >= 65) & (t.chunk.buf <= 90))


def n_lower(t: Texts) -> np.ndarray:
    return _per_doc(t.chunk, (t.chunk.buf >= 97) & (t.chunk.buf <= 122))


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each line that has a word."""
    c = t.chunk
    breaks = np.flatnonzero(c.buf == 10)
    starts = np.union1d(breaks + 1, c.offsets[:-1])
    starts = starts[starts < len(c.buf)]
    doc = np.searchsorted(c.offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(c.buf))[np.searchsorted(breaks, starts)], c.offsets[doc + 1])
    inside = np.zeros(len(c.buf) + 1, np.int64)
    np.cumsum(~SPACE[c.buf], out=inside[1:])
    full = inside[ends] > inside[starts]
    return span_hashes(c.buf, starts[full], ends[full], lower=False), doc[full]


def n_lines(t: Texts) -> np.ndarray:
    return np.bincount(_lines(t)[1], minlength=len(t.chunk))


def n_dup_lines(t: Texts) -> np.ndarray:
    h, doc = _lines(t)
    _, first = np.unique(mix(h + mix(doc.astype(U64))), return_index=True)
    return np.bincount(doc, minlength=len(t.chunk)) - np.bincount(doc[first], minlength=len(t.chunk))


def n_repeat_words(t: Texts) -> np.ndarray:
    starts, ends, firsts = t.words
    h, at = windows(span_hashes(t.chunk.buf, starts, ends, lower=False), firsts, WINDOW)
    doc = np.repeat(np.arange(len(t.chunk)), np.diff(at))
    _, which, counts = np.unique(mix(h + mix(doc.astype(U64))), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[which] >= 2)
    word = firsts[doc[twice]] + twice - at[doc[twice]]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + WINDOW, -1)
    covered = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.cumsum(edge[:-1]) > 0, out=covered[1:])
    return covered[firsts[1:]] - covered[firsts[:-1]]


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_upper, n_lower, n_lines, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects`` of the named measures is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda words: words < 20),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda repeat, words: 100 * repeat > 30 * words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda symbols, words: 10 * symbols > 3 * words),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda dup, lines: 10 * dup > 3 * lines),
    Rule("word_length", ("word_chars", "n_words"), lambda chars, words: (chars > 20 * words) | (chars < 2 * words)),
    Rule("upper_case", ("n_upper", "n_lower"), lambda upper, lower: upper > lower),
)


def order_rules(column: pa.Array, rules: tuple[Rule, ...], free: frozenset[str] = frozenset()) -> list[Rule]:
    """The rules by sampled rejections per second; measures in ``free`` are made anyway and cost nothing."""
    cost, hits, n = dict.fromkeys(MEASURES, 1e-9), dict.fromkeys((r.name for r in rules), 0), 0
    for chunk in chunks(column):
        n += len(chunk)
        got = {}
        for name in sorted({m for r in rules for m in r.needs}):
            began = time.perf_counter()
            got[name] = MEASURES[name](Texts(chunk))
            cost[name] += 0 if name in free else time.perf_counter() - began
        for r in rules:
            hits[r.name] += int(r.rejects(*(got[m] for m in r.needs)).sum())
    return sorted(rules, key=lambda r: -((hits[r.name] + 0.5) / (n + 1)) / sum(cost[m] for m in r.needs))


def measure(column: pa.Array, rules: list[Rule], always: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The measures in ``always`` of every text, and which texts no rule rejects."""
    out, kept = {m: [] for m in always}, []
    for chunk in chunks(column):
        texts = Texts(chunk)
        known = {m: MEASURES[m](texts) for m in always}
        for m in always:
            out[m].append(known[m])
        alive, now = np.arange(len(chunk)), texts
        for rule in rules:
            if not len(alive):
                break
            for m in rule.needs:
                if m not in known:
                    known[m] = np.zeros(len(chunk), np.int64)
                    known[m][alive] = MEASURES[m](now)
            bad = rule.rejects(*(known[m][alive] for m in rule.needs))
            if bad.any():
                alive = alive[~bad]
                now = Texts(_only(chunk, alive))
        keep = np.zeros(len(chunk), bool)
        keep[alive] = True
        kept.append(keep)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return {m: join(v, np.int64) for m, v in out.items()}, join(kept, bool)


def _only(chunk: Chunk, alive: np.ndarray) -> Chunk:
    sizes = chunk.offsets[alive + 1] - chunk.offsets[alive]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    parts = [chunk.buf[chunk.offsets[i] : chunk.offsets[i + 1]] for i in alive]
    return Chunk(chunk.first, np.concatenate(parts) if parts else chunk.buf[:0], offsets)


def _ordered(docs: DataFrame, rules: tuple[Rule, ...], always: tuple[str, ...], sample: int, id_col: str, text_col: str) -> list[Rule]:
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample).distinct()
    texts = docs.join(F.broadcast(ids), docs[id_col].eqNullSafe(ids["_id"]), "left_semi").select(docs[text_col]).limit(4 * sample).toArrow().column(0)
    return order_rules(texts, rules, frozenset(always))


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, always: tuple[str, ...] = (), sample: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the measures in ``always`` and ``kept`` of every row.

    ``sample`` bounds the documents that costs and selectivities are estimated
    on (those with the lowest hashes of their ids).
    """
    ordered = _ordered(docs, rules, always, sample, id_col, text_col)

    def judge(batches):
        for b in batches:
            got, kept = measure(b.column(1), ordered, always)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[m]) for m in always), pa.array(kept)], names=["id", *always, "kept"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(judge, ", ".join([f"id {kind}", *(f"{m} long" for m in always), "kept boolean"])).withColumnRenamed("id", id_col)


def quality_filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns; nothing is shuffled."""
    ordered, at = _ordered(docs, rules, (), sample, id_col, text_col), docs.columns.index(text_col)

    def judge(batches):
        for b in batches:
            yield b.filter(pa.array(measure(b.column(at), ordered, ())[1]))

    return docs.mapInArrow(sparing(judge), docs.schema)
