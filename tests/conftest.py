import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compare import session
    from storyloom.session import tune

    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def entities(spark, folder):
    from storyloom.sources.entities import Entities

    return Entities(spark, folder)
