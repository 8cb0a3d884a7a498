import pytest

from warraq.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
