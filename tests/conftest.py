import pytest


@pytest.fixture(scope="session")
def spark():
    from lumenfold.session import local_session

    return local_session("4")
