import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from flightloom.session import local_session

    session = local_session(cores="4", shuffle_partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from flightloom.plans.registry import Tables

    return Tables(spark, "/root/testdata/sf0.001")
