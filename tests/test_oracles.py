"""Every core query against its SQL oracle."""

import pytest

from pricelattice.plans import catalog, coverage, extended, market  # noqa: F401  (they add their queries)
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_oracle(spark, name):
    if name in catalog.ORACLES:
        compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0
