"""One session for all tests; its scratch folders are new for each run."""

from __future__ import annotations

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-tests-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.local.dir", f"{scratch}/local")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    """The smallest tables."""
    return str(DATA / "sf0.001")
