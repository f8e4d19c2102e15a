"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from postsignal.plans.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check_oracle.oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    equal, note = check_oracle.compare(spark, connection, name, SF_DIR)
    assert equal, note


def test_only_the_decomposition_has_no_sql():
    missing = set(QUERIES) - set(contract.oracle_sql())
    assert missing == {"svd_singular_values", "svd_project"}


def test_entry(spark):
    assert contract.entry(spark).count() > 0
