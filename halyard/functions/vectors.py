"""Vector functions over ``array<float>`` columns, in Spark expressions; and a hashed text embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions.text import py_ngrams, py_phonetic, py_tokens_search


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector and for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def sign_agreement(a: Column, b: Column) -> Column:
    """The share of places with the same sign, zero counting as positive."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x >= 0) == (y >= 0), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(same, F.size(a)), F.lit(0.0))).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """0.3 of sign agreement and 0.7 of the positive cosine; 0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), 0.3 * sign_agreement(a, b) + 0.7 * F.greatest(cosine(a, b), F.lit(0.0))).otherwise(F.lit(0.0))


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in vector))


_PRIME, _ONE, _TWO, _MASK = 0x100000001B3, 0xCBF29CE484222325, 0x84222325CBF29CE4, 2**64 - 1


def _fnv(data: bytes, seed: int) -> int:
    for c in data:
        seed = (seed ^ c) * _PRIME & _MASK
    return seed


def embed(text: str, size: int = 64) -> np.ndarray:
    """A signed projection of tokens (3), their phonetic keys (2) and n-grams (1) on four places each, of length one."""
    out = np.zeros(max(size, 16), np.float32)
    for tok in py_tokens_search(text):
        for feature, weight in [(tok, 3.0), (py_phonetic(tok), 2.0), *((g, 1.0) for g in py_ngrams(tok))]:
            if feature:
                h, g = _fnv(feature.encode(), _ONE), _fnv(feature.encode(), _TWO)
                for k in range(4):
                    turned = (h << 16 * k | h >> (64 - 16 * k)) & _MASK if k else h
                    out[(turned + g * (k + 1) & _MASK) % len(out)] += -weight if h >> 7 * k & 1 else weight
    length = float(np.sqrt((out.astype(float) ** 2).sum()))
    return out / np.float32(length) if length > 1e-8 else out


def embedding(c: Column, size: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: embed(x or "", size).tolist())

    return run(c)
