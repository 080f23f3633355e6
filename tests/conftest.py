import pytest

from sparsefold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, shuffle_partitions=4)
    yield session
    session.stop()
