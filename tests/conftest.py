import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segue.session import drop_materialised, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("segue-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_materialised(session)
    session.stop()
