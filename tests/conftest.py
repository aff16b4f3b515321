import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from holdfast.session import local_session, release_scratch  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("holdfast-tests", cores="4", memory="4g")
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SF
