import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from veritext.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()


def one(spark, expr, data, schema):
    """Evaluate a column expression over a small in-code frame."""
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


@pytest.fixture(scope="module", autouse=True)
def nothing_cached_by_other_modules():
    """What a module's tests have cached goes with it, as others count what is cached."""
    yield
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is not None:
        session.catalog.clearCache()
