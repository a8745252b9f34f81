import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keyfold.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        4, "keyfold-tests", **{"spark.driver.memory": "6g", "spark.checkpoint.dir": shared}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
