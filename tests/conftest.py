import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tideline.session import drop_written, local_session

    s = local_session("8", "tideline-tests")
    yield s
    drop_written(s)
    s.stop()
