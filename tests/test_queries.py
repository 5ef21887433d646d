"""Every registered query equals its SQL on the smallest tables."""

import pytest

from checks.compare import difference
from checks.oracle import ORACLE
from checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    assert difference(spark, oracle, SMALL, name).startswith("equal")
