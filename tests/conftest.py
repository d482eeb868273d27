import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from postloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def value(spark):
    """Evaluate an expression (column or SQL text) over one row of text."""
    from pyspark.sql import functions as F

    def run(make, text):
        expr = make(F.col("t"))
        return spark.createDataFrame([(text,)], "t string").select(expr.alias("v")).first()["v"]

    return run
