"""Documents with the awkward cases of every operator."""

from __future__ import annotations

import random

import pytest

LONG = "word " * 60_000 + "x" * 50_000


@pytest.fixture(scope="session")
def prose():
    """Texts of made-up words; the same seed gives the same texts."""
    def make(n, seed, lo=30, hi=90):
        rng = random.Random(seed)
        syllables = ["the", "on", "er", "tion", "an", "re", "he", "in", "ed", "nd", "ha", "at"]
        word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        return [" ".join(word() for _ in range(rng.randint(lo, hi))) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, blanks, repeats and a very long text."""
    return [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "b", 3), (5, "é ñ  Ünï\n\nÜnï", "xx", "b", 9), (5, "é ñ  Ünï\n\nÜnï", "xx", "b", 9), (None, "no id here at all", None, None, None), (6, LONG, "en", "c", len(LONG)), (7, "A b C d E f", "en", "c", 11), (8, "a B c D e F", "en", "c", 11)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns named as operators name theirs.
CLASH = SCHEMA + ", score string, held_out string, row string, h string, s string, key string, taken string, id string, tile string, y string, kept string, _id string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clash(spark, odd_rows):
    return spark.createDataFrame([(*r, *("z" * 12)) for r in odd_rows], CLASH)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
