"""Chunks merged in any order equal one pass; a new chunk leaves the others alone."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from propel.operators import chunks as ck
from propel.operators import features as ft
from propel.session import unique_dir


def table(spark, n=600):
    rng = random.Random(6)
    rows = [(rng.randrange(25), rng.randrange(40), rng.choice([1, 2, 3, 4, 5, None]), datetime(2000, 1, 1) + timedelta(days=rng.randrange(900)), rng.randrange(4)) for _ in range(n)]
    rows += [(99, None, None, datetime(2000, 1, 1), 0), (98, 1, 4, datetime(2001, 1, 1), 2), (None, 3, 5, datetime(2001, 1, 1), 1)]
    return spark.createDataFrame(rows, "user_id long, movie_id long, rating int, date timestamp, chunk int")


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_chunks_in_any_order_equal_one_pass(spark):
    df = table(spark)
    want = rows(ft.user_rating_agg(df))
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        path = unique_dir(spark, "chunks")
        for c in order:
            ck.write_chunks(df.where(F.col("chunk") == c), path)
        assert rows(ck.read_merged(spark, path)) == want
    ck.write_chunks(df.where("chunk = 2"), path)                  # a repeated chunk replaces itself
    assert rows(ck.read_merged(spark, path)) == want


def test_a_new_chunk_touches_only_itself(spark):
    df, path = table(spark), unique_dir(spark, "chunks")
    ck.write_chunks(df.where("chunk < 3"), path)
    files = lambda: {f: os.path.getmtime(os.path.join(d, f)) for c in range(3) for d, _, fs in os.walk(f"{path}/moments/chunk={c}") for f in fs}
    before = files()
    ck.write_chunks(df.where("chunk = 3"), path)
    assert before and files() == before and rows(ck.read_merged(spark, path)) == rows(ft.user_rating_agg(df))


def test_sketch_form_and_empty(spark):
    df, path = table(spark), unique_dir(spark, "chunks")
    ck.write_chunks(df, path)
    exact, about = ({r.user_id: r.unique_movies for r in ck.read_merged(spark, path, e).collect()} for e in (True, False))
    assert set(exact) == set(about) and all(abs(exact[u] - about[u]) <= 1 + 0.05 * exact[u] for u in exact)
    assert ck.merge(ck.moments(df.limit(0)), ck.pairs(df.limit(0))).count() == 0
