import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import make_spark

    s = make_spark("tests", "4", 4, spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
