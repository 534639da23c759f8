import pytest


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import session

    s = session(cpus="4", partitions=4, memory="4g")
    yield s
    s.stop()
