"""Per-user rating aggregates kept as a state that chunks of ratings are merged into.

A chunk's state is two small tables: moments per user (count, mean, squared deviations,
extremes) and the distinct (user, movie) pairs, or a distinct-count sketch per user.
Each chunk is written to a partition of its own, so a new or repeated chunk reads and
replaces only itself, and merging reads states, never ratings. Chunks merge in any
order to the result of one pass over all ratings (the distinct count of the sketch form
is approximate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propel.functions.core import ts


def moments(ratings: DataFrame, *chunk: str) -> DataFrame:
    """One row per user (and chunk column): what :func:`merge` needs, without the distinct movies."""
    return ratings.groupBy("user_id", *chunk).agg(
        F.count("movie_id").alias("total_ratings"), F.count("rating").alias("n"), F.avg("rating").alias("mean"),
        (F.var_pop("rating") * F.count("rating")).alias("m2"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
        F.min(ts("date")).alias("first_rating_date"), F.max(ts("date")).alias("last_rating_date"),
        F.hll_sketch_agg(F.col("movie_id").cast("long")).alias("movies"))


def pairs(ratings: DataFrame, *chunk: str) -> DataFrame:
    """Distinct (user, movie) pairs (per chunk column)."""
    return ratings.where("movie_id IS NOT NULL").select("user_id", "movie_id", *chunk).distinct()


def write_chunks(ratings: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Write the states of the chunks in ``ratings`` (named by column ``chunk``) under ``path``; states
    of the same names are replaced, others stay as they are."""
    for name, df in (("moments", moments(ratings, chunk)), ("pairs", pairs(ratings, chunk))):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk)
         .parquet(f"{path.rstrip('/')}/{name}"))


def merge(states: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """The columns of ``user_rating_agg`` from states of any chunks; ``distinct``: their pairs, for exact
    distinct movies (estimated from the sketches without them)."""
    part = F.struct("n", "mean", "m2")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a, b):
        """Moments of two parts together."""
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        share = F.coalesce(F.try_divide(b["n"].cast("double"), n.cast("double")), F.lit(0.0))
        return F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * share).alias("m2"))
    g = states.groupBy("user_id").agg(
        F.sum("total_ratings").alias("total_ratings"),
        F.aggregate(F.sort_array(F.collect_list(F.when(F.col("n") > 0, part))), zero, add).alias("_s"),     # one part per chunk
        F.min("min_rating").alias("min_rating"), F.max("max_rating").alias("max_rating"),
        F.min("first_rating_date").alias("first_rating_date"), F.max("last_rating_date").alias("last_rating_date"),
        F.hll_sketch_estimate(F.hll_union_agg("movies")).alias("_about"))
    if distinct is not None:
        u = distinct.select("user_id", "movie_id").groupBy("user_id").agg(F.countDistinct("movie_id").alias("_exact"))
        g = g.join(u.withColumnRenamed("user_id", "_u"), F.expr("user_id <=> _u"), "left")
    unique = F.coalesce("_exact", F.lit(0)) if distinct is not None else F.col("_about")
    n = F.col("_s.n")
    return g.select("user_id", "total_ratings", unique.cast("long").alias("unique_movies"),
                    F.when(n > 0, F.col("_s.mean")).alias("mean_rating"), F.sqrt(F.try_divide(F.when(n > 1, F.col("_s.m2")), n - 1)).alias("std_rating"),
                    "min_rating", "max_rating", "first_rating_date", "last_rating_date")


def read_merged(spark: SparkSession, path: str, exact: bool = True) -> DataFrame:
    """The aggregate over all chunks written under ``path``."""
    at = path.rstrip("/")
    return merge(spark.read.parquet(f"{at}/moments"), spark.read.parquet(f"{at}/pairs") if exact else None)
