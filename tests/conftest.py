import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lexeval.session import get_spark
    s = get_spark("local[8]", app_name="lexeval-tests", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF_SMALL = "/root/testdata/sf0.001"
