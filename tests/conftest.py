import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()
