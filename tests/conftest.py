"""One session for all tests."""

from __future__ import annotations

import pytest

from seamline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=8, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
