import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("SILTSTONE_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from siltstone.session import build_session

    session = build_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"
