import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fathom import session

    own = session.local(4, 4)
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
