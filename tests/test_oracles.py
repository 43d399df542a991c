"""Every registered query against its SQL, and those without SQL for rows."""

import compare
import pytest

from arenalake.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert compare.differences(df, con, registry.ORACLES[name]) is None
    else:
        assert df.count() > 0
