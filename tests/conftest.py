import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fairstream.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", app="fairstream-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """A DataFrame ``value`` of the given lines, with ``id`` in order."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "id bigint, value string")

    return make
