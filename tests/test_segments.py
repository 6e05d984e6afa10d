"""All starts at once against single runs, Spark ML and brute force."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from propel.ml import segments as seg


def cloud(n=300, seed=1):
    rng = np.random.default_rng(seed)
    mids = np.array([[0, 0], [6, 0], [0, 6], [7, 7]])
    x = mids[np.arange(n) % 4] + rng.normal(size=(n, 2)) * 1.2
    return [(int(i), float(a), float(b), "uvwz"[i % 4] if rng.random() < 0.9 else "u") for i, (a, b) in enumerate(x)]


def test_cost_is_that_of_the_best_run(spark):
    rows = cloud()
    df = spark.createDataFrame(rows, "id long, a double, b double, c string").repartition(4)
    out, cost = seg.segments(df, "id", ["a", "b"], starts=6)
    got = {r.id: r.segment for r in out.collect()}
    assert len(got) == len(rows) and set(got.values()) == {0, 1, 2, 3}
    x = np.array([r[1:3] for r in rows])
    lab = np.array([got[r[0]] for r in rows])
    mean = np.stack([x[lab == j].mean(axis=0) for j in range(4)])
    d = ((x[:, None] - mean[None]) ** 2).sum(axis=2)
    assert abs(d[np.arange(len(x)), lab].sum() - cost) < 1e-2
    assert (d.argmin(axis=1) == lab).mean() > 0.99
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    assert cost <= 1.001 * min(KMeans(k=4, seed=s).fit(v).summary.trainingCost for s in range(3))
    again, same = seg.segments(df.repartition(2), "id", ["a", "b"], starts=6)
    assert same == cost and {r.id: r.segment for r in again.collect()} == got


def test_categories_decide_where_numbers_do_not(spark):
    rows = [(i, 0.0, "p" if i % 3 else "q", "r") for i in range(60)] + [(60, None, None, "r")]
    df = spark.createDataFrame(rows, "id long, a double, c string, d string")
    out, cost = seg.segments(df, "id", ["a"], ["c", "d"], k=2, starts=4, gamma=1.0)
    got = {r.id: r.segment for r in out.collect()}
    assert len({got[i] for i in range(60) if i % 3}) == 1 and len({got[i] for i in range(60) if not i % 3}) == 1
    assert got[0] != got[1] and abs(cost - 1.0) < 1e-6       # only the row without category differs


def test_few_equal_and_no_rows(spark):
    one = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, a double")
    out, cost = seg.segments(one, "id", ["a"], starts=2)
    assert out.count() == 2 and cost == 0.0
    none, cost = seg.segments(one.limit(0), "id", ["a"])
    assert none.count() == 0 and cost == 0.0
