import pytest

from pricelattice.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
    s.stop()
