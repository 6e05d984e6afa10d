"""Histogram boosting, Shapley attribution and Parzen search against brute force."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from propel.ml import boosting as gb
from propel.ml import models as ml
from propel.ml import parzen, shap
from propel.operators import features as ft
from propel.sources.tables import Tables

FEATURES = [c for c in ft.RATING_FEATURE_COLUMNS if c not in ("user_id", "cross_sell_propensity")]


@pytest.fixture(scope="module")
def table(spark):
    return ft.quantile_label(ft.rating_features(Tables(spark, SF_MID).ratings())).cache()


def rows(n=500, nf=4, seed=1):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 9, (n, nf)).astype(np.uint8)
    p = 1 / (1 + np.exp(-(bins[:, 0] - 4.0) - 0.7 * (bins[:, 1] > 5) * (bins[:, 2] - 4.0)))
    return bins, (rng.random(n) < p).astype(np.int64), rng.integers(-2**62, 2**62, n), rng.integers(0, 100, n), rng.integers(0, 100, n)


def naive_node(bins, g, h, at, depth, spec):
    """Recursive tree by trying every cut of every feature: (value, feature, cut, left, right)."""
    gs, hs = int(g[at].sum()) / gb.SCALE, int(h[at].sum()) / gb.SCALE
    best = None
    if depth < spec.max_depth:
        for f in range(bins.shape[1]):
            for c in range(9):
                left = at & (bins[:, f] <= c)
                gl, hl = int(g[left].sum()) / gb.SCALE, int(h[left].sum()) / gb.SCALE
                gr, hr = gs - gl, hs - hl
                if hl < 1 or hr < 1:
                    continue
                gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - gs ** 2 / (hs + 1)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, c)
    value = -spec.learning_rate * gs / (hs + 1)
    if best is None:
        return (value, -1, 0, None, None)
    _, f, c = best
    return (value, f, c, naive_node(bins, g, h, at & (bins[:, f] <= c), depth + 1, spec), naive_node(bins, g, h, at & (bins[:, f] > c), depth + 1, spec))


def naive_value(node, x):
    while node[1] >= 0:
        node = node[3] if x[node[1]] <= node[2] else node[4]
    return node[0]


def model(spec, nf=4):
    return gb.Model(spec, [f"x{i}" for i in range(nf)], [np.arange(8.0)] * nf)


def test_equal_to_naive_boosting():
    bins, y, key, a, b = rows()
    spec = gb.Spec(n_estimators=12, max_depth=3, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0, train=tuple(range(80)), valid=tuple(range(20)))
    m = gb.grow_alone(model(spec), bins, y, key, a, b, 12)
    train = (a < 80) & (b >= 20)
    z = np.full(len(y), gb.base_margin(int(y[train].sum()), int(train.sum())))
    losses = []
    for t in range(12):
        v = (a < 80) & (b < 20)
        losses.append(sum(round(math.log1p(math.exp(-s if k else s)) * gb.SCALE) for s, k in zip(z[v], y[v])))
        g, h = gb.gradients(y, z)
        tree = naive_node(bins, g, h, train, 0, spec)
        z = z + np.array([naive_value(tree, x) for x in bins])
        assert np.allclose(gb.Model(spec, m.features, m.edges, m.base, m.trees[:t + 1]).margins(bins), z, atol=1e-12)
    assert len(m.trees) == 12 and np.allclose(m.losses[:12], losses, atol=2)


def test_patience_ends_a_model_and_keeps_its_best_trees():
    bins, y, key, a, b = rows(seed=3)
    y = np.random.default_rng(0).integers(0, 2, len(y))          # nothing to learn
    m = gb.grow_alone(model(gb.Spec(valid=tuple(range(30)), early_stopping_rounds=7)), bins, y, key, a, b, 200)
    assert m.done and len(m.trees) < 200 and len(m.trees) - int(np.argmin(m.losses)) == 7
    assert len(m.final().trees) == int(np.argmin(m.losses))


def test_sampling_follows_the_rates():
    key = rows(4000)[2]
    spec = gb.Spec(subsample=0.8)
    share = [gb.sampled(spec, key, r) for r in range(5)]
    assert all(abs(s.mean() - 0.8) < 0.03 for s in share) and (share[0] != share[1]).any()
    assert len(gb.columns(spec, 10, 0)) == 8 and any((gb.columns(spec, 10, r) != gb.columns(spec, 10, 0)).any() for r in range(1, 5))


def binned(spark, data, parts):
    bins, y, key, a, b = data
    rs = [(int(k), int(t), int(p), int(q), bytes(x)) for x, t, k, p, q in zip(bins, y, key, a, b)]
    return spark.createDataFrame(rs, "key long, y int, a int, b int, bins binary").repartition(parts)


def same(x, y):
    assert x.base == y.base and x.losses == y.losses and x.done == y.done and len(x.trees) == len(y.trees)
    for s, t in zip(x.trees, y.trees):
        assert s == t


def test_grouped_passes_equal_models_grown_alone(spark, monkeypatch):
    monkeypatch.setattr(gb, "REWRITE", 3)
    data = rows(300, seed=5)
    df = binned(spark, data, 3)
    specs = [gb.Spec(n_estimators=7, max_depth=2, learning_rate=0.3, valid=tuple(range(20))),
             gb.Spec(n_estimators=4, max_depth=3, learning_rate=0.2, subsample=0.6, seed=9, train=tuple(range(50))),
             gb.Spec(n_estimators=9, max_depth=1, learning_rate=2.0, valid=tuple(range(40)), early_stopping_rounds=2)]
    alone = gb.fit_models(df, [model(s) for s in specs])
    grouped = gb.fit_models(df, [model(s) for s in specs], local_bytes=0)
    for x, y in zip(alone, grouped):
        same(x, y)
    half = gb.fit_models(df, [model(s) for s in specs], stop=3)
    assert [len(m.trees) for m in half] == [3, 3, 3]
    for x, y in zip(alone, gb.fit_models(df, half)):
        same(x, y)


def test_shapley_values_by_all_coalitions():
    bins, y, key, a, b = rows(400, 5, seed=7)
    m = gb.grow_alone(gb.Model(gb.Spec(n_estimators=4, max_depth=3, learning_rate=0.3), list("abcde"), [np.arange(8.0)] * 5), bins, y, key, a, b, 4)

    def expect(t, node, x, known):
        f = t.feature[node]
        if f < 0:
            return t.value[node]
        if f in known:
            return expect(t, t.left[node] if x[f] <= t.cut[node] else t.right[node], x, known)
        return sum(t.cover[c] / t.cover[node] * expect(t, c, x, known) for c in (t.left[node], t.right[node]))
    some = bins[:25].astype(np.int64)
    got = shap.contributions([p for t in m.trees for p in shap.leaf_paths(t)], some, 5)
    for r, x in enumerate(some):
        for j in range(5):
            others = [i for i in range(5) if i != j]
            want = sum(math.factorial(k) * math.factorial(4 - k) / math.factorial(5)
                       * sum(expect(t, 0, x, {*s, j}) - expect(t, 0, x, set(s)) for t in m.trees)
                       for k in range(5) for s in itertools.combinations(others, k))
            assert abs(got[r, j] - want) < 1e-9
    assert np.abs(got.sum(axis=1) + shap.base_value(m) - m.margins(some)).max() < 1e-9


def test_tree_attribution_adds_up(spark, table):
    m = ml.propensity_train(table, FEATURES, params={"n_estimators": 20})
    top = ml.tree_attribution_topk(table, m, "user_id")
    assert top.count() == table.count()
    assert top.where(F.abs(F.col("margin") - F.col("base") - F.col("total")) > 1e-9).count() == 0
    assert top.where(F.size("top_contributions") != 5).count() == 0
    assert "propensity by" in ml.attribution_text(top).first().reasoning


def test_parzen_beats_random_draws():
    ranges = {"learning_rate": (0.01, 0.3), "max_depth": (3, 10), "subsample": (0.6, 1.0)}

    def worth(t):
        return -(math.log(t["learning_rate"] / 0.08)) ** 2 - 0.3 * (t["max_depth"] - 6) ** 2 - 20 * (t["subsample"] - 0.85) ** 2
    found, drawn = [], []
    for seed in range(12):
        s = parzen.Search(ranges, seed)
        for _ in range(8):
            ts = s.propose(5)
            s.tell(ts, [worth(t) for t in ts])
        found.append(max(s.values))
        r = parzen.Search(ranges, 1000 + seed, startup=10**9)
        drawn.append(max(worth(t) for t in r.propose(40)))
        assert all(3 <= t["max_depth"] <= 10 and 0.01 <= t["learning_rate"] <= 0.3 for t in s.propose(5))
    assert np.mean(found) > np.mean(drawn)
    a, b = parzen.Search(ranges, 5), parzen.Search(ranges, 5)
    assert a.propose(7) == b.propose(7)


def test_folds_and_trials_end_in_time_and_repeat(spark, table):
    t0 = time.time()
    cv = [tuple(r) for r in ml.cross_validate(table, FEATURES).orderBy("fold").collect()]
    assert time.time() - t0 < 120
    assert len(cv) == 5 and all(auc > 0.7 for _, auc in cv)
    t0 = time.time()
    t = ml.tune_params(table, FEATURES, n_trials=6)
    assert time.time() - t0 < 240
    rs = t.orderBy("trial").collect()
    assert [r.trial for r in rs] == list(range(6)) and sum(r.best for r in rs) == 1
    best = next(r for r in rs if r.best)
    assert best.validation_auc == max(r.validation_auc for r in rs) and best.test_auc > 0.7


def test_empty_and_one_class_tables(spark, table):
    none = ml.propensity_train(table.limit(0), FEATURES, params={"n_estimators": 3})
    assert ml.score(none, table.limit(2)).count() == 2
    one = ml.propensity_train(table.withColumn("target", F.lit(1)), FEATURES, params={"n_estimators": 3})
    assert ml.score(one, table).agg(F.min("propensity_score")).first()[0] > 0.9
