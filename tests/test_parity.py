"""Every registered engine query against its SQL in an independent database."""

import math

import pytest
from engine_tables import SF

from driftgauge.plans import extras, surface, templates, tpch, workload

QUERIES = workload.queries() | tpch.queries() | templates.queries() | surface.queries() | extras.queries()
ORACLES = workload.oracle_sql() | tpch.oracle_sql() | templates.oracle_sql() | surface.oracle_sql() | extras.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name, monkeypatch):
    monkeypatch.setattr(tpch, "PSWR_BUDGET", 3_000_000)  # what a query without a matching row spends
    df = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_entry():
    import __spark_entry__

    assert {*ORACLES} <= {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
