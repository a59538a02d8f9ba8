import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapeledger.operators.ordered import BLOCK_ROWS_CONF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "split"])
def any_split(request, spark):
    """Run a test with whole sets per task, and again with sets cut into blocks of four rows."""
    if request.param == "split":
        spark.conf.set(BLOCK_ROWS_CONF, "4")
    yield request.param
    spark.conf.unset(BLOCK_ROWS_CONF)


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, v if not isinstance(v, (list, dict)) else str(v)) for v in t))
