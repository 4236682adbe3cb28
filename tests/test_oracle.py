"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import DATA

import __spark_entry__ as registered
from checks.oracle import all_sql
from checks.queries import all_queries

SQL = all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(SQL) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, data, con, name):
    assert compare(all_queries()[name](spark, data), con, SQL[name]) == []


def test_entry(spark):
    assert registered.entry(spark).columns == ["user_id", "rank", "product", "total"]
