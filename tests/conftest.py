import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", "tidemark-tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
