import pytest

from cytospark.queries import ORACLES, QUERIES

from .oracles import differ, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert differ(df, con, ORACLES[name]) == ""
    else:
        df.collect()
