import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]


@pytest.fixture(scope="session")
def spark():
    from emberfield.session import local_session

    session = local_session("tests", cores=8, shuffle=4)
    yield session
    session.stop()
