import pytest

from quern import session


@pytest.fixture(scope="session")
def spark():
    built = session.build("local[4]", "tests", spark__ui__enabled="false", spark__sql__shuffle__partitions="4")
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
