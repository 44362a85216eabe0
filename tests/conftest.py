import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import harness  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = harness.session()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return f"{harness.TESTDATA}/{os.environ.get('TEST_SF', 'sf0.001')}"


@pytest.fixture(scope="session")
def duck(sf_dir):
    return harness.duck(sf_dir)
