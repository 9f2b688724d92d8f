import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import session

    made = session(4, 4, "4g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
