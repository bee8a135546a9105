import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fieldmill.session import build_session
    s = build_session("local[4]", app="fieldmill-tests", shuffle_partitions=8)
    # tests own their checkpoint folder (a cluster names a shared one)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldmill-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture
def apply1(spark):
    """Apply a Column function to a list of strings; return the results."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]
    return run


@pytest.fixture
def tmpdir_new():
    return tempfile.mkdtemp(prefix="fieldmill-test-", dir="/tmp")
