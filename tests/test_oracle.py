"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    problem, _ = compare(spark, duck, FOLDER, name, entry.queries()[name], ORACLE[name])
    assert not problem, problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
