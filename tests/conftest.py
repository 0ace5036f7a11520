import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tailcast.session import local_session
    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
