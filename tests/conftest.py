from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sealroute-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from sealroute.session import attach

    yield attach(session)
    session.stop()


@pytest.fixture
def keys(spark):
    """Key material made for the run; the second secret is wrapped the way a key store returns it."""
    import json
    import secrets

    rows = [("alpha", secrets.token_hex(16)), ("beta", json.dumps({"value": f" {secrets.token_hex(16)}\n"}))]
    return spark.createDataFrame(rows, "key_id string, material string")
