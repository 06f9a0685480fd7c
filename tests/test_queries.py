"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from halyard.queries import ORACLES, QUERIES, entry_query
from tests.compare import FOLDER, check, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES.get(name))


def test_entry(spark):
    assert entry_query(spark, FOLDER).count() > 0


def test_entry_module_needs_no_corpus_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith(("halyard.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return real(name, *args, **kwargs)

    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert "filter_eq" in entry.queries() and not any(k.startswith("op1_") or k == "pipeline" for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
