"""Every registered query against its SQL at the smallest scale."""

import os

import pytest
from check_queries import compare, connect, entry

from treeledger.workload.registry import QUERIES, SQL

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_expected_answers(spark):
    queries = entry.queries()
    if not SF.endswith("sf0.001"):
        pytest.skip("answers are known for sf0.001")
    assert queries["compare_counts"](spark, SF).first().asDict() == {
        "added": 30, "removed": 25, "resized": 43, "total": 98, "delta_bytes": 73743 - 46678 - 43}
    assert queries["six_class"](spark, SF).first().asDict() == {
        "added": 19, "removed": 13, "replaced": 20, "resized": 17, "metadata_changed": 12, "unchanged": 46}
    assert queries["hardlink_sizes"](spark, SF).first().asDict() == {
        "unique_bytes": 438410, "allocated_bytes": 851968, "allocation_errors": 4}
    assert entry.entry(spark).count() == 1
