"""The positive-unlabelled risk: gradient by finite differences, and that it decides."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from conftest import SF_MID

from propel.llm import toxicity
from propel.llm import queries as Q


def sample(seed=1):
    rng = np.random.default_rng(seed)
    make = lambda n, lo, hi: [np.unique(rng.integers(lo, hi, 5)) for _ in range(n)]
    return toxicity.Sample(make(7, 0, 8), make(20, 4, 12))


@pytest.mark.parametrize("pi,branch", [(0.1, False), (0.9, True)])
def test_gradient_by_finite_differences(pi, branch):
    s, rng = sample(), np.random.default_rng(3)
    w = rng.normal(size=13) * 0.3
    if branch:
        w[:4] += 2.0         # confirmed rows score high, the others do not
    g, below = toxicity.gradient(s, w, pi)
    assert bool(below) == branch == bool(toxicity.risk(s, w, pi)[1] < 0)
    part = lambda w: -toxicity.risk(s, w, pi)[1] if branch else sum(toxicity.risk(s, w, pi))
    for j in range(13):
        e = np.zeros(13)
        e[j] = 1e-5
        assert abs((part(w + e) - part(w - e)) / 2e-5 - g[j]) < 1e-7


def planted(n, seed=4, rate=0.2):
    """Word sets of which ``rate`` hold bad words 0 to 5, the rest common ones only; and their truth."""
    rng = random.Random(seed)
    rows, bad = [], []
    for _ in range(n):
        t = rng.random() < rate
        f = {rng.randrange(100, 3000) for _ in range(30)} | ({rng.randrange(6) for _ in range(2)} if t else set())
        rows.append(np.array(sorted(f), np.int32))
        bad.append(t)
    return rows, bad


def test_the_loss_decides_and_the_prior_is_found():
    rows, bad = planted(3000)
    confirmed = [f for f, b in zip(rows[:1500], bad) if b][:150]
    w, pi = toxicity.train(confirmed, rows[:1500])
    assert abs(pi - sum(bad[:1500]) / 1500) < 0.06
    z = np.array([w[f].sum() + w[-1] for f in rows[1500:]])
    y = np.array(bad[1500:])
    assert ((z > 0) == y).mean() > 0.97
    w0 = toxicity.learn(confirmed, rows[:1500], pi, epochs=0, refit=0)
    assert not w0.any()
    assert (w[:6] > 0).all() and np.abs(w[100:-1]).max() < w[:6].min()      # the words that matter


def auc(score, y):
    order = np.unique(score, return_inverse=True)[1]
    pos, neg = order[y], order[~y]
    return np.mean([(pos > n).mean() + 0.5 * (pos == n).mean() for n in neg])


def test_held_out_auc(spark):
    """Zero epochs score all texts alike (AUC 0.5); the fitted risk beats that by 0.35 at least."""
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF_MID}/labels.parquet").to_pylist()}
    rows = [r for r in Q.QUERIES["op9_toxicity"](spark, SF_MID).collect() if label.get(r.doc_id) is not None]
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    y = np.array([label[r.doc_id] == 1 for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.85
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.93


def test_clashing_columns_text_ids_and_repeats(spark):
    df = spark.createDataFrame([("a", "bad word here", 1, "x", 2), ("a", "bad", 1, "x", 2), (None, None, 1, "x", 2), ("b", "", 1, "x", 2)],
                               "doc_id string, text string, score int, f string, doc int")
    lab = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "doc_id string, toxic int")
    w = toxicity.fit(toxicity.training_rows(df, lab))
    out = toxicity.score(df, w)
    assert out.columns == [*df.columns, "__score"]
    assert sorted(map(repr, (tuple(r)[:-1] for r in out.collect()))) == sorted(map(repr, (tuple(r) for r in df.collect())))
