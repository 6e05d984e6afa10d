"""Randomised properties of the distributed primitives (hypothesis)."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from propel.functions.prefix import running_sums
from propel.functions.quantile import exact_quantiles
from propel.operators import experiments as ex

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=300)


@SETTINGS
@given(vals=values, q=st.floats(0, 1))
def test_exact_quantile_equals_pandas(spark, vals, q):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, "x", [q], buckets=8).first().q0
    exp = pd.Series(vals).quantile(q)
    assert math.isclose(got, exp, rel_tol=1e-9, abs_tol=1e-9)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 20), st.integers(1, 9)), min_size=1, max_size=300))
def test_running_sums_equal_cumsum(spark, rows):
    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, v long")
    got = {r.id: r.cum_v for r in running_sums(df, ["k", "id"], ["v"], buckets=4).collect()}
    pdf = pd.DataFrame(data, columns=["id", "k", "v"]).sort_values(["k", "id"])
    assert all(got[i] == c for i, c in zip(pdf.id, pdf.v.cumsum()))


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=2, max_size=200))
def test_auc_equals_pairwise_count(spark, rows):
    df = spark.createDataFrame([(y, s / 12.0) for y, s in rows], "label int, score double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    got = ex.auc_roc(df, buckets=4).first().auc
    if not pos or not neg:
        assert got is None
        return
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert math.isclose(got, wins / (len(pos) * len(neg)), rel_tol=1e-12)
