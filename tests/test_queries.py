"""Every query with SQL gives what DuckDB gives; the others run and have rows."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

OWN = {name: f for module in entry.MODULES for name, f in module.QUERIES.items()}
SQL = {name: s for module in entry.MODULES for name, s in module.SQL.items()}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def same(spark, duck, name, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns, name
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert found == wanted, name


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    same(spark, duck, name, OWN[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_runs(spark, name):
    assert OWN[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
