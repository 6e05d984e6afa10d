"""Block files grow in number, lines stay where they are read."""

import os
import tempfile

from pyspark.sql import functions as F

from propel.session import unique_dir
from propel.sources import files as fs


def ratings(spark, n=4000):
    return spark.range(n).select((F.col("id") % 97).alias("user_id"), (F.col("id") % 41).alias("movie_id"), (1 + F.col("id") % 5).cast("int").alias("rating"),
                                 F.timestamp_seconds(86400 * (F.col("id") % 700)).alias("date"))


def test_block_files_grow_with_the_rows_and_lines_are_not_shuffled(spark, monkeypatch):
    r = ratings(spark)
    path = fs.write_rating_blocks(r, unique_dir(spark, "blocks"), files=2, rows_per_file=500)
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]) == 8
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")     # headers in earlier splits
    try:
        back = fs.read_rating_blocks(spark, path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, r.collect()))
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") >= 1 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_before_the_first_header(spark):
    d = tempfile.mkdtemp(prefix="lines-")
    with open(f"{d}/a.txt", "w") as f:
        f.write("1,2,2005-01-01\n\nx:\n7:\n2,3,2005-01-02\n2,x,2005-01-02\n8:\n 3,4,2005-01-03\n3,4\n")
    got = sorted((r.user_id, r.movie_id, r.rating) for r in fs.read_rating_blocks(spark, d).collect())
    assert got == [(1, None, 2), (2, 7, 3), (3, 8, 4)]
