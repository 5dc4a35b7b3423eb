import pytest


@pytest.fixture(scope="session")
def spark():
    from pitlake.session import build_session

    session = build_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
