"""Every analytics query with SQL agrees with it; those without run."""

import pytest
from compare import assert_same

from riskweave.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def test_all_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
