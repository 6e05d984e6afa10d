"""Drift from stored profiles against the exact form."""

import numpy as np
import pytest

from propel.operators import validation as vd
from propel.session import unique_dir


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    make = lambda n, shift: spark.createDataFrame(
        [(float(a), float(b), None if i % 10 == 0 else float(a)) for i, (a, b) in enumerate(zip(rng.normal(shift, 1, n), rng.exponential(2 + shift, n)))], "a double, b double, c double")
    return make(4000, 0.0), make(3000, 0.3)


def rows(df):
    return {r.feature: r for r in df.collect()}


def test_profile_form_is_near_the_exact_form(spark, sides):
    base, cur = sides
    path = unique_dir(spark, "profile")
    vd.drift_profile(base, ["a", "b", "c"]).write.parquet(path)
    exact = rows(vd.drift_vs_baseline(base, cur, ["a", "b", "c"]))
    got = rows(vd.drift_from_profiles(spark.read.parquet(path), vd.drift_profile(cur, ["a", "b", "c"])))
    assert set(got) == set(exact) == {"a", "b", "c"}
    for f, e in exact.items():
        g = got[f]
        for c in ("baseline_mean", "baseline_std", "current_mean", "mean_shift_std"):
            assert g[c] == pytest.approx(e[c], rel=1e-9)
        assert abs(g.psi - e.psi) < 0.02
        x, y = (np.sort([r[0] for r in d.select(f).collect() if r[0] is not None]) for d in (base, cur))
        at = np.concatenate([x, y])
        ks = np.abs(np.searchsorted(x, at, side="right") / len(x) - np.searchsorted(y, at, side="right") / len(y)).max()
        assert abs(g.ks - ks) <= g.ks_error


def test_profiles_of_parts_merge(spark, sides):
    base, cur = sides
    parts = [p for p in base.randomSplit([0.2, 0.5, 0.3], seed=4)]
    merged = None
    for p in reversed(parts):
        q = vd.drift_profile(p, ["a", "b", "c"])
        merged = q if merged is None else merged.unionByName(q)
    one, many = rows(vd.drift_profile(base, ["a", "b", "c"])), rows(vd.merge_profiles(merged))
    for f in one:
        assert many[f].n == one[f].n
        assert many[f]["mean"] == pytest.approx(one[f]["mean"], rel=1e-9) and many[f].m2 == pytest.approx(one[f].m2, rel=1e-9)
    c = vd.drift_profile(cur, ["a", "b", "c"])
    x, y = rows(vd.drift_from_profiles(vd.merge_profiles(merged), c)), rows(vd.drift_from_profiles(vd.drift_profile(base, ["a", "b", "c"]), c))
    assert all(abs(x[f].psi - y[f].psi) < 0.03 and abs(x[f].ks - y[f].ks) <= x[f].ks_error for f in x)


def test_exact_form_empty_side(spark, sides):
    base, cur = sides
    got = rows(vd.drift_vs_baseline(base, cur.limit(0), ["a", "b"]))
    assert set(got) == {"a", "b"} and got["a"].current_mean is None
