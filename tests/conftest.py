import pytest

from kgweave.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
