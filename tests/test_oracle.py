"""Every named query against its SQL, at the smallest scale."""

import pytest

from catalog.oracle import oracle_sql
from catalog.queries import queries
from tests.check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf_dir, con, name):
    assert compare(queries()[name](spark, sf_dir), con, oracle_sql()[name]) == ""
