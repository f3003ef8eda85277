import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paddock.session import get_spark

    s = get_spark("local[4]", app="paddock-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.exists(f"{SMALL}/lineitem.parquet"):
        pytest.skip("driver test tables not present")
    return SMALL
