import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture(params=["whole groups", "blocks"])
def layout(spark, request):
    """Run a test with groups kept whole, then cut into blocks and with no table broadcast
    but those of one row per block."""
    if request.param == "blocks":
        spark.conf.set("loomframe.rowsPerBlock", "2")
        spark.conf.set("loomframe.broadcastBytes", "-1")
    yield request.param
    spark.conf.unset("loomframe.rowsPerBlock")
    spark.conf.unset("loomframe.broadcastBytes")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=repr)


def same(df, expected, *cols):
    want = sorted((tuple(plain(v) for v in r) for r in expected), key=repr)
    got = rows(df, *cols)
    assert got == want


@pytest.fixture
def frame(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)
