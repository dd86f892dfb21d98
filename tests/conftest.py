import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cosignal.session import get_spark
    s = get_spark("local[8]", shuffle_partitions=8,
                  extra={"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF0001
