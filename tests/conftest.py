import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from duelgrid.session import local_session
    session = local_session("tests", 8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def ws(spark, sf):
    from duelgrid.plans.workspace import workspace
    return workspace(spark, sf)
