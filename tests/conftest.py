import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from evalspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def rows(spark):
    """Builds a frame from a schema text and rows."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
