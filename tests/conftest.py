"""One session for all tests, on this machine."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyshelf.session import local_session

    session = local_session(cpus=os.environ.get("TEST_CPUS", "4"), app="tests", partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest of the driver's tables."""
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
