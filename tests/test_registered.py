"""Every registered query on the smallest tables, next to its DuckDB check."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in CHECKS:
        verdict = compare(df, con, CHECKS[name])
        assert verdict.startswith("ok"), verdict
    else:
        assert df.count() > 0
