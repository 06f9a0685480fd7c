"""The hashing kernel against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm.text import chunks, shingle_sets, span_hashes, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tÀé\x0b\x85A", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1 << 20]))
def test_words(texts, size):
    got = []
    for c in chunks(pa.array(texts, pa.string()), size):
        starts, ends, firsts = c.words()
        words = [bytes(c.buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
        got += [words[firsts[i] : firsts[i + 1]] for i in range(len(c))]
    assert got == [WORD.findall(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    def plain(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [s for c in chunks(pa.array(texts, pa.string())) for s in shingle_sets(c)]
    want = [plain(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_hashes_do_not_depend_on_where_a_word_stands():
    long = b"x" * 3_000_000 + b" tail"
    for buf in (b"tail", b"  tail", long):
        a = np.frombuffer(buf, np.uint8)
        at = buf.rindex(b"tail")
        starts, ends = (np.array([0, at]), np.array([at - 1, at + 4])) if at > 2 else (np.array([at]), np.array([at + 4]))
        h = span_hashes(a, starts, ends, lower=True)[-1]
        assert h == span_hashes(np.frombuffer(b"TAIL", np.uint8), np.array([0]), np.array([4]), lower=True)[0]


def test_windows_stay_within_documents():
    h, at = windows(np.arange(7, dtype=np.uint64), np.array([0, 3, 3, 7]), 3)
    assert at.tolist() == [0, 1, 1, 3] and len(h) == 3
