"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare
from conftest import SMALL

from cohortloom.catalog import ORACLES, QUERIES

ROWS_ONLY_SLOW = {"forest_results", "boosted_results", "svm_results", "network_results"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ROWS_ONLY_SLOW])
def test_query_matches_sql(spark, name):
    assert compare(spark, SMALL, QUERIES[name], ORACLES.get(name)) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
