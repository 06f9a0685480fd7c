"""One local session for all tests, with the shared folder in a temporary place."""

from __future__ import annotations

import pytest

from halyard.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
