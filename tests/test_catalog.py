"""Every registered query of the engine's own operators against its DuckDB twin."""

import pytest

from tests.conftest import SF, same
from timeloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        same(got, duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)
