"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import pytest

from check_oracles import compare, duck
from tollgate.plans import catalog

QUERIES = catalog.queries()
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_small, con, key):
    ok, msg = compare(spark, sf_small, key, QUERIES[key], ORACLES.get(key), con)
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["date", "unique_users", "total_sessions", "avg_session_seconds", "total_data_gb",
                          "revenue_kes"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
