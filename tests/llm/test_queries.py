"""The registered corpus queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from halyard.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import FOLDER, check, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    check(spark, connect(), QUERIES[name], ORACLE_SQL.get(name))
