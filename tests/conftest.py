import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glossmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "glossmill-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def column(spark):
    """Evaluate a column function on one text."""

    def run(fn, *values):
        from pyspark.sql import functions as F

        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], names)
        return df.select(fn(*[F.col(n) for n in names]).alias("out")).first()["out"]

    return run
