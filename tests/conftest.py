import pytest

from cleanloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, app="tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
