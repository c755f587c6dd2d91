import pytest

from corpusloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
