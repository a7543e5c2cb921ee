import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from litscore.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """The value of a column expression of one string."""

    def run(expression, value):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(value,)], "s STRING")
        return df.select(expression(F.col("s")).alias("v")).first()["v"]

    return run
