"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    rows_only = {"embedding_inference", "propensity_report", "amount_model", "feature_importance", "amount_error"}
    assert set(QUERIES) - set(ORACLE) == rows_only


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0
