import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from litlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over one string."""
    from pyspark.sql import functions as F

    def run(function, value, *more):
        return spark.createDataFrame([(value,)], "v string").select(function(F.col("v"), *more).alias("x")).first()[0]

    return run
