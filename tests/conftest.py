import pytest

from docmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, partitions=4, name="tests")
