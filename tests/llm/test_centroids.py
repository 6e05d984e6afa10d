"""VA-file clustering against plain Lloyd rounds in Python."""

import hashlib
import math
import random

import numpy as np

from propel.llm import centroids


def brute(rows, k=8, rounds=10, dim=64):
    vs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(vs, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]
    cs = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vs]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(vs, own) if o == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, *reversed(near(v))) for i, v in vs]
    per = [sum(d for _, c, d in out if c == j) for j in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((i, c, d, per[c], sum(per), sha[c]) for i, c, d in out)


def groups(n, seed, spread):
    rng = random.Random(seed)
    mids = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in mids[i % 6]]) for i in range(n)]


def found(df, **kw):
    return sorted(tuple(r[c] for c in ("vec_id", "__cluster", "__distance", "__cluster_inertia", "__inertia", "__centroid_sha256"))
                  for r in centroids.cluster(df, **kw).collect())


def test_against_lloyd_with_edges(spark):
    rows = groups(180, 1, 0.3) + [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [1.0] * 63 + [None]),
                                  (505, [float("nan")] * 64), (506, [float("inf")] * 64), (507, [0.0] * 64), (508, [0.0] * 64), (509, [9.0] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, row string").repartition(5)
    assert found(df) == brute(rows)
    assert centroids.cluster(df).columns[:4] == df.columns
    assert found(df, bits=2) == brute(rows)


def test_ties_repeats_few_and_empty(spark):
    rows = [(i % 3, [float(i % 2)] * 64) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(df)
    assert len(got) == 40 and all(d == 0 for _, _, d, *_ in got)
    few = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    assert found(spark.createDataFrame(few, "vec_id long, embedding array<float>")) == brute(few)
    assert found(df.limit(0)) == []
    nameless = spark.createDataFrame([(None, [0.5] * 64), (None, [0.25] * 64)], "vec_id long, embedding array<double>")
    assert centroids.cluster(nameless).count() == 2


def test_cells_decide_most_vectors():
    """The cells' verdict is that of exact distances wherever they give one."""
    x = np.array([[math.floor(1024 * c) for c in v] for _, v in groups(600, 2, 0.2)])
    lo, hi = x.min(0), x.max(0)
    edge = np.stack([np.concatenate([lo[d] + (hi[d] + 1 - lo[d]) * np.arange(64) // 64, [hi[d] + 1]]) for d in range(64)])
    cells = np.stack([np.searchsorted(edge[d, 1:-1], x[:, d], side="right") for d in range(64)], axis=1)
    got = centroids.decide(cells, centroids.bounds(edge, x[:6]))
    exact = centroids.nearest(x, x[:6])[0]
    assert (got >= 0).mean() > 0.9
    assert (got[got >= 0] == exact[got >= 0]).all()
