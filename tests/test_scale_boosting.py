"""Work of a boosting round and of the grouped form's passes."""

import numpy as np

from propel.ml import boosting as gb
from propel.ml import models as ml


def grown(n=4000, depth=5, trees=3):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 30, (n, 6)).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 1] * (bins[:, 2] > 9) + rng.normal(0, 3, n) > 25).astype(np.int64)
    m = gb.Model(gb.Spec(n_estimators=trees, max_depth=depth), list("abcdef"), [np.arange(29.0)] * 6)
    return gb.grow_alone(m, bins, y, rng.integers(-2**62, 2**62, n), rng.integers(0, 100, n), rng.integers(0, 100, n), trees), bins


def test_a_level_sums_only_the_lighter_children(monkeypatch):
    met, plain = [], gb.histogram

    def counted(bins, g, h, slot, *rest):
        met.append(int((slot >= 0).sum()))
        return plain(bins, g, h, slot, *rest)
    monkeypatch.setattr(gb, "histogram", counted)
    grown(trees=1)
    assert len(met) == 5                                        # the leaves' level needs no pass
    assert sum(met[1:]) < 4 * met[0] * 0.75                     # all rows before, at every level


def test_rows_of_the_grouped_form_are_packed(spark):
    rows = [(i, i % 2, i % 100, (i * 7) % 100, bytes([i % 9, i % 5])) for i in range(500)]
    table = spark.createDataFrame(rows, "key long, y int, a int, b int, bins binary")
    packed = gb.pack(table, 2, 1, 500)
    assert packed.count() <= spark.sparkContext.defaultParallelism + 1
    got = packed.toArrow().to_batches()
    assert sorted((int(k), int(t), bytes(x)) for b in got for m, y, key, *_ in gb._blocks([b], 2) for x, t, k in zip(m, y, key)) \
        == sorted((k, t, x) for k, t, _, _, x in rows)


def test_importance_without_an_active_session(spark):
    import threading
    m, _ = grown()
    got = []
    t = threading.Thread(target=lambda: got.extend(ml.feature_importance(m, list("abcdef")).collect()))
    t.start()
    t.join()
    assert len(got) == 6 and abs(sum(r.importance for r in got) - 1) < 1e-9


def some_rows(n=6000, seed=4):
    rng = np.random.default_rng(seed)
    sizes = [40, 64, 5, 2, 64, 2, 17]
    bins = np.stack([rng.integers(0, k, n) for k in sizes], axis=1).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 1] * bins[:, 3] + rng.normal(0, 9, n) > 45).astype(np.int64)
    return sizes, (bins, y, rng.integers(-2**62, 2**62, n), rng.integers(0, 100, n), rng.integers(0, 100, n))


def test_rows_dealt_to_processes_give_the_same_model():
    sizes, data = some_rows()
    edges = [np.arange(k - 1.0) for k in sizes]
    for depth, rounds in ((1, 3), (6, 8)):
        spec = gb.Spec(n_estimators=rounds, max_depth=depth, learning_rate=0.3, valid=tuple(range(20)))
        one, three, many = (gb.grow_alone(gb.Model(spec, list("abcdefg"), edges), *data, rounds, hands) for hands in (1, 3, 9))
        for m in (three, many):                                 # 9: more processes than features
            assert m.trees == one.trees and m.losses == one.losses and m.base == one.base


def test_a_process_that_fails_ends_the_model():
    import pytest
    sizes, (bins, y, key, a, b) = some_rows(3000)
    bins[2900:] = 200                                           # no such bins: sums of the last process fail
    m = gb.Model(gb.Spec(n_estimators=2, max_depth=2), list("abcdefg"), [np.arange(k - 1.0) for k in sizes])
    with pytest.raises((EOFError, OSError)):
        gb.grow_alone(m, bins, y, key, a, b, 2, 3)


def test_cores_are_dealt_by_the_levels_to_come():
    models = [gb.Model(gb.Spec(n_estimators=n, max_depth=d), ["x"], [np.zeros(1)]) for n, d in ((400, 9), (400, 3))]
    assert gb.deal_hands(models, 500, 10**8, 8, 8) == [6, 2]
    assert gb.deal_hands(models[:1], 500, 10**8, 8, 8) == [8]
    assert gb.deal_hands(models, 500, 10**8, 6, 2) == [2, 2]    # no more than an executor has
    assert gb.deal_hands(models, 500, 1000, 8, 8) == [1, 1]     # a small table is not dealt
    assert gb.deal_hands(models * 5, 500, 10**8, 4, 4) == [1] * 10


def test_features_of_a_team_share_a_table(monkeypatch):
    sizes, (bins, y, *_) = some_rows(50000)
    rng, met = np.random.default_rng(1), []
    g, h, slot = rng.integers(-999, 999, len(y)).astype(float), rng.integers(0, 99, len(y)).astype(float), rng.integers(-1, 4, len(y))
    cols = np.array([0, 1, 2, 4, 6])
    teams = gb.Codes.teams

    def counted(self, *args):
        met.append(len(teams(self, *args)[0]))
        return teams(self, *args)
    monkeypatch.setattr(gb.Codes, "teams", counted)
    got = gb.histogram(bins, g, h, slot, 4, 64, cols, sizes)
    assert max(met) < 5                                         # a row was added once for each feature
    for s in range(4):
        for j, f in enumerate(cols):
            for i, v in enumerate((g, h)):
                assert (got[i, s, j] == np.bincount(bins[slot == s, f], v[slot == s], 64)).all()


def test_trials_and_refit_share_one_binned_table(spark, monkeypatch):
    rows = [(i, float(i % 37), float(i * i % 101), int(i % 37 + i * i % 101 > 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, x0 double, x1 double, target int").cache()
    made, scored, binned, aucs = [], [], gb.binned, ml.aucs
    monkeypatch.setattr(gb, "binned", lambda *a, **k: made.append(1) or binned(*a, **k))
    monkeypatch.setattr(ml, "aucs", lambda models, *a: scored.append(len(models)) or aucs(models, *a))
    t = ml.tune_params(df, ["x0", "x1"], n_trials=3, generation=3, first_rung=4, ranges={**ml.TUNE_RANGES, "n_estimators": (6, 9)}).collect()
    assert len(t) == 3 and len(made) == 1
    assert scored == [3, 2, 1]                                  # all at the rung, the two that grew on, the refit
