"""Every registered query beside its SQL on the tables the driver checks, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from barflow.plans.registry import QUERIES
from tests.check import compare, duck

ORACLE = entry.oracle_sql()
#: Large enough that every query has rows.
SF = os.environ.get("BARFLOW_QUERY_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract_needs_no_session():
    assert set(ORACLE) <= set(entry.queries())
    assert set(QUERIES) <= set(ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 52


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert compare(df, con, ORACLE[name]) == ""
    assert con.execute(f"SELECT count(*) FROM ({ORACLE[name]})").fetchall()[0][0] > 0
