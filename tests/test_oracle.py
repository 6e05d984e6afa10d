"""Every keyed query equals its DuckDB oracle on the smallest fixture."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

ORACLE = E.oracle_sql()
KEYS = sorted(ORACLE)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


def test_every_query_key_is_registered():
    q = E.queries()
    assert len(q) >= 140
    assert set(ORACLE) <= set(q)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "cross_sell_propensity" in df.columns


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[key])
    d_cols, d_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(st, st) == d_types[f.name], (f.name, st, d_types[f.name])
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
