import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nichelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "nichelens-tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one expression over a list of strings."""

    def run(inputs, expression):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i int, x string")
        got = df.select("i", expression(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(got, key=lambda r: r["i"])]

    return run
