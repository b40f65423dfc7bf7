import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexatlas.session import build_session

    session = build_session("tests", "8", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def micro(spark):
    """Eight rows whose statistics have been worked out by hand."""
    rows = [(1, 1.0, 0.0, 0), (2, 2.0, 0.0, 0), (3, 3.0, 1.0, 0), (4, 4.0, 0.0, 0), (5, 5.0, 2.0, 1), (6, 6.0, 3.0, 1), (7, 7.0, 0.0, 1), (8, 8.0, 4.0, -1)]
    return spark.createDataFrame(rows, "id long, y double, x double, cluster_id int")
