"""Top-k, latest-row and window-shaped operators.

* Top-k per group is ``row_number() <= k`` over a partitioned window; Spark
  plans it with a partial ``WindowGroupLimit`` before the shuffle, so a hot
  group ships at most k rows per map task, never the whole group.
* Global top-k is ``orderBy().limit()`` (TakeOrderedAndProject: k rows per
  task, merged once).
* Latest row per key is a ``max_by`` aggregate (partial aggregation, no sort).
* Running counts over a global order go through :mod:`propel.functions.prefix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propel.functions import prefix
from propel.functions.core import elapsed_days, ts
from propel.operators import decisions as dc


def order_cols(order: Sequence) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, str):
            out.append(F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc())
        else:
            out.append(o)
    return out


def topk_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int,
                   rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group (ties broken by the order list, R5)."""
    w = Window.partitionBy(*group).orderBy(*order_cols(order))
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= k)


def global_topk(df: DataFrame, order: Sequence, k: int, rank_col: str | None = "rank") -> DataFrame:
    """Top k rows overall, with their 1..k rank (the window runs on k rows only)."""
    top = df.orderBy(*order_cols(order)).limit(k)
    if rank_col is None:
        return top
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order_cols(order))).cast("long"))


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The newest row per key: max_by over a struct of the order columns."""
    ordering = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in cols])
    g = df.groupBy(key).agg(F.max_by(payload, ordering).alias("_p"))
    return g.select(key, *[F.col(f"_p.{c}").alias(c) for c in cols])


def latest_prediction(customers: DataFrame, predictions: DataFrame) -> DataFrame:
    """Newest score, model version and time written back on the customer row."""
    lp = latest_per_key(predictions, "customer_id", ["created_at", "id"],
                        ["propensity_score", "model_version", "created_at"])
    lp = lp.select("customer_id", F.col("propensity_score").alias("latest_propensity_score"),
                   F.col("model_version").alias("latest_model_version"),
                   F.col("created_at").alias("last_prediction_at"))
    return customers.join(lp, "customer_id", "left")


def prediction_history(predictions: DataFrame, n: int = 10) -> DataFrame:
    """Latest n predictions per customer."""
    return topk_per_group(predictions, ["customer_id"], ["-created_at", "-id"], n)


def agent_queue(agents: DataFrame, assignments: DataFrame, profile: DataFrame, k: int = 10,
                min_score: float = 0.2, score: str = "latest_propensity_score") -> DataFrame:
    """Prioritised queue for every agent at once: assigned customers with a score
    above min_score, top k by score, with urgency, reasoning and channel.
    Unknown agents and agents without assignments yield no rows."""
    a = assignments.join(agents.select("agent_id"), "agent_id", "left_semi")
    p = profile.where(F.col(score) > min_score)
    j = a.join(p, "customer_id")
    top = topk_per_group(j, ["agent_id"], [F.col(score).desc(), F.col("customer_id").asc()], k)
    pts = dc.urgency_points(score)
    urg = dc.urgency_level(pts)
    prod = (F.coalesce(F.col("latest_recommended_product"), F.lit(dc.QUEUE_PRODUCT_DEFAULT))
            if "latest_recommended_product" in profile.columns else F.lit(dc.QUEUE_PRODUCT_DEFAULT))
    return top.select("agent_id", "rank", "customer_id",
                      F.round(score, 4).alias("propensity_score"),
                      prod.alias("recommended_product"),
                      urg.alias("urgency"),
                      dc.reasoning_long().alias("reasoning"),
                      dc.suggest_channel(urg).alias("suggested_channel"))


def running_count_trigger(df: DataFrame, order: Sequence[str], threshold: int = 10,
                          buckets: int | None = None) -> DataFrame:
    """Cumulative row count under a global order; flag from the threshold-th row on."""
    x = df.withColumn("_one", F.lit(1).cast("long"))
    r = prefix.running_sums(x, order, ["_one"], buckets=buckets)
    return (r.withColumnRenamed("cum__one", "running_count").drop("_one")
            .withColumn("retrain_triggered", F.col("running_count") >= threshold))


PERIOD_UNIT = {"daily": "day", "weekly": "week", "monthly": "month"}


def revenue_trend(orders: DataFrame, period: str = "weekly", treated: str = "F", baseline: str = "O") -> DataFrame:
    """Per period: cumulative baseline and treated revenue and their difference.
    The window runs over period buckets (bounded by the time span, not the rows)."""
    unit = PERIOD_UNIT[period]
    o = orders.select(F.date_trunc(unit, ts("o_orderdate")).alias("bucket"), "o_orderstatus", "o_totalprice")
    g = o.groupBy("bucket").agg(
        F.sum(F.when(F.col("o_orderstatus") == baseline, F.col("o_totalprice")).otherwise(0.0)).alias("b"),
        F.sum(F.when(F.col("o_orderstatus") == treated, F.col("o_totalprice")).otherwise(0.0)).alias("n"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("baseline", F.sum("b").over(w)).withColumn("nba", F.sum("n").over(w))
    return g.select(F.date_format("bucket", "yyyy-MM-dd").alias("date"),
                    F.round("baseline", 2).alias("baseline"), F.round("nba", 2).alias("nba"),
                    F.round(F.col("nba") - F.col("baseline"), 2).alias("uplift"))


def daily_activity_series(predictions: DataFrame, feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """N rolling 24 h bins back from as_of: predictions and feedback per bin, zeros kept."""
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))

    def binned(df, name):
        b = elapsed_days(F.col("created_at"), start)
        return (df.select(b.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < days))
                .groupBy("bin").agg(F.count(F.lit(1)).alias(name)))
    spine = predictions.sparkSession.range(days).select(F.col("id").cast("long").alias("bin"))
    out = (spine.join(binned(predictions, "predictions"), "bin", "left")
           .join(binned(feedback, "feedback"), "bin", "left"))
    day = start + F.make_dt_interval(F.col("bin").cast("int"))
    return out.select(F.date_format(day, "yyyy-MM-dd").alias("date"),
                      F.coalesce("predictions", F.lit(0)).alias("predictions"),
                      F.coalesce("feedback", F.lit(0)).alias("feedback"))


def first_n_users_prefix(df: DataFrame, n: int, user: str = "user_id", pos: str = "pos") -> DataFrame:
    """All rows up to and including the row where the n-th distinct user first appears.

    Each user's first position is one aggregate; the n-th smallest of those is
    found by the distributed running count (no top-n sort held in one task,
    whatever n is); fewer than n users keeps every row.
    """
    from propel.session import materialize
    first = materialize(df.groupBy(user).agg(F.min(pos).alias("_fp")).withColumn("_one", F.lit(1).cast("long")))
    ranked = prefix.running_sums(first, ["_fp", user], ["_one"])
    cutoff = ranked.agg(F.max(F.when(F.col("cum__one") <= n, F.col("_fp"))).alias("_cut"))  # one row
    return df.crossJoin(F.broadcast(cutoff)).where(F.col(pos) <= F.col("_cut")).drop("_cut")
