import pytest

from pagewright.session import importable_on_workers, local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    importable_on_workers(session)
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
