import pytest

from quern.plans import catalog, further, more  # noqa: F401
from tests.compare import connect, same

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    own, other = same(catalog.QUERIES[name](spark, DIR), con, catalog.ORACLES[name])
    assert own[1] == other[1]
    assert len(own[0]) == len(other[0])
    assert own[0] == other[0]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).limit(1).count() == 1
