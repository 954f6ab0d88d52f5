import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from tastegrid.session import build_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TASTEGRID_DRIVER_MEMORY", "4g")
    s = build_session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
