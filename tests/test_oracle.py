"""Every registered query against its SQL on the smallest data."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from oracle import catalogue as sql
from retailflow.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    problem, _ = compare(catalogue.QUERIES[name](spark, SF), con, sql.STATEMENTS[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
