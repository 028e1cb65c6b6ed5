import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from veilstone.session import local_session

    session = local_session("4", "tests", spark__sql__shuffle__partitions="4")
    yield session


@pytest.fixture(scope="session")
def data_dir():
    return DATA
