import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[8]", shuffle_partitions=4, driver_memory="8g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
