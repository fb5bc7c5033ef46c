"""Every registered query with a SQL text gives the same rows as DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from check import compare
from conftest import SMALL

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


def test_entry_gives_all_roles(spark):
    rows = entry_module.entry(spark).collect()
    assert {r.role for r in rows} == {"Top", "Jungle", "Mid", "ADC", "Support"}
