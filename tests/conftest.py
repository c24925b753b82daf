import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sensorlake.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="sensorlake-tests")
    yield s


@pytest.fixture(scope="session")
def sf001():
    return SF001
