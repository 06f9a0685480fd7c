"""The formula language: values, undefined results, limits and error codes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from halyard.plans.formula import FormulaError, compile_formula

VALUES = {"h": 12.0, "m": 100.0, "none": None, "a-b": 5.0, "ns/x": 7.0}


@pytest.fixture(scope="module")
def evaluate(spark):
    row = spark.createDataFrame([(1,)], "i int")

    def run(*texts):
        var = lambda n: F.lit(VALUES[n]).cast("double")
        return list(row.select(*(compile_formula(t, var).alias(f"c{i}") for i, t in enumerate(texts))).first())

    return run


CASES = [("1 + 2 * 3", 7), ("-2^2", 4), ("2^3^2", 512), ("(1 + 2) * 3", 9), ("10 / 4", 2.5), ("10 % 4", 2), ("h / 0", None), ("h % 0", None), ("MOD(m, 7)", 2), ("MOD(m, 0)", None), ("ABS(-h)", 12), ("CEIL(1.2)", 2), ("FLOOR(-1.2)", -2), ("SIGN(-3)", -1), ("SIGN(0)", 0),
         ("ROUND(2.5)", 3), ("ROUND(-2.5)", -3), ("ROUND(6.25, 1)", 6.3), ("SQRT(16)", 4), ("SQRT(-1)", None), ("LOG(1)", 0), ("LOG(0)", None), ("LOG10(1000)", 3), ("POWER(2, 10)", 1024), ("NULLIF(h, 12)", None), ("NULLIF(h, 1)", 12), ("COALESCE(none, h)", 12),
         ("IF(none, 1, 2)", 1), ("IF(0, 1, 2)", 2), ("IF(h, 1, 2)", 1), ("GREATEST(1, none, 3)", 3), ("LEAST(4)", 4), ("CLAMP(h, 0, 10)", 10), ("CLAMP(none, 0, 1)", None), ("a-b + 1", 6), ("ns/x * 2", 14), ("h - 2", 10), ("none + 1", None), ("COALESCE(h / NULLIF(0, 0), -1)", -1), ("1e3 + .5", 1000.5)]


def test_values(evaluate):
    for (text, want), got in zip(CASES, evaluate(*(t for t, _ in CASES)), strict=True):
        assert got == (None if want is None else pytest.approx(want)), text


@pytest.mark.parametrize("text,code", [("", "FML_013"), ("1 +", "FML_001"), ("1 $ 2", "FML_001"), ("(1", "FML_002"), ("1)", "FML_002"), ("FOO(1)", "FML_003"), ("ABS(1, 2)", "FML_004"), ("SELECT 1", "FML_007"), ("1; 2", "FML_007"), ("1" * 5000, "FML_008"), ("(" * 40 + "1" + ")" * 40, "FML_009"), ("1+" * 300 + "1", "FML_010"), ("ABS(" * 17 + "1" + ")" * 17, "FML_011")])
def test_errors(evaluate, text, code):
    with pytest.raises(FormulaError) as e:
        evaluate(text)
    assert e.value.code == code


def test_words_inside_names_are_no_keywords(spark):
    row = spark.createDataFrame([(3.0,)], "selection_count double")
    assert row.select(compile_formula("selection_count * 2", lambda n: F.col(n))).first()[0] == 6
