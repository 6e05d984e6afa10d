"""Dashboard and agent reports.

Each report is one grouped pass (conditional counts inside a single
aggregate) instead of the many scalar queries of a request handler; one-row
results are cross-joined by broadcast, which is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.functions.core import guard_div, ts
from propel.operators import decisions as dc


def named_counts(df: DataFrame, col: str, names: Sequence[str], out_name: str = "name",
                 out_value: str = "value") -> DataFrame:
    """Counts per name, every listed name present (zero kept), NULL excluded."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    spine = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{out_name} string, _ord int")
    return (F.broadcast(spine).join(g, F.col(out_name) == F.col(col), "left")
            .select(out_name, F.coalesce("_n", F.lit(0)).cast("long").alias(out_value)))


def segment_distribution(scored: DataFrame, score: str = "latest_propensity_score") -> DataFrame:
    seg = dc.lookup(dc.SEGMENT_NAMES_LONG, dc.segment_by_score(score), "Unknown")
    s = scored.select(F.when(F.col(score).isNotNull(), seg).alias("segment_name"))
    return named_counts(s, "segment_name", list(dc.SEGMENT_NAMES_LONG.values()))


def region_distribution(customers: DataFrame) -> DataFrame:
    return customers.groupBy("region").agg(F.count(F.lit(1)).alias("count"))


def dashboard_summary(matrix: DataFrame, customers: DataFrame, segment_col: str = "segment") -> DataFrame:
    """total, mean target x 100 (rounded 1), segment and region counts as maps."""
    head = matrix.agg(F.count(F.lit(1)).alias("total_customers"),
                      F.round(F.avg("target") * 100, 1).alias("avg_propensity_score"))
    segs = (matrix.where(F.col(segment_col).between(0, 3))
            .groupBy(segment_col).agg(F.count(F.lit(1)).alias("n"))
            .select(dc.lookup(dc.SEGMENT_NAMES, segment_col).alias("k"), "n"))
    names = segs.sparkSession.createDataFrame([(v,) for v in dc.SEGMENT_NAMES.values()], "k string")
    segs = F.broadcast(names).join(segs, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))
    seg_map = segs.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("segment_distribution"))
    reg = (customers.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
           .agg(F.map_from_entries(F.collect_list(F.struct("region", "n"))).alias("region_distribution")))
    return head.crossJoin(F.broadcast(seg_map)).crossJoin(F.broadcast(reg))


def dashboard_kpis(customers: DataFrame, feedback: DataFrame, as_of: str,
                   score: str = "latest_propensity_score") -> DataFrame:
    c = customers.agg(F.count(F.lit(1)).alias("total_customers"), F.count(score).alias("predicted_customers"),
                      F.avg(score).alias("_avg"))
    month_start = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    f = (feedback.where(ts("created_at") >= month_start)
         .agg(F.count(F.lit(1)).alias("monthly_feedback"),
              F.count_if(F.col("outcome") == "converted").alias("monthly_conversions")))
    j = c.crossJoin(f)
    return j.select("total_customers", "predicted_customers",
                    F.round(guard_div("predicted_customers", "total_customers") * 100, 1).alias("coverage_rate"),
                    F.round(F.coalesce("_avg", F.lit(0.0)) * 100, 1).alias("average_propensity_score"),
                    "monthly_feedback", "monthly_conversions",
                    F.round(guard_div("monthly_conversions", "monthly_feedback") * 100, 1).alias("conversion_rate"))


FUNNEL_STAGES = ["Total Customers", "Predictions Made", "Agent Actions", "Conversions"]


def conversion_funnel(customers: DataFrame, feedback: DataFrame, score: str = "latest_propensity_score") -> DataFrame:
    c = customers.agg(F.count(F.lit(1)).alias("a"), F.count(score).alias("b"))
    f = feedback.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("outcome") == "converted").alias("d"))
    j = c.crossJoin(f)
    stages = F.array(*[F.struct(F.lit(i + 1).alias("stage_order"), F.lit(n).alias("stage"),
                                F.col(k).alias("count")) for i, (n, k) in enumerate(zip(FUNNEL_STAGES, "abcd"))])
    return j.select(F.inline(stages),
                    F.round(guard_div("b", "a") * 100, 1).alias("prediction_coverage"),
                    F.round(guard_div("d", "c") * 100, 1).alias("conversion_rate"))


def observed_conversion(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count(F.lit(1)).alias("total_predictions"),
                        F.count_if(F.col("outcome") == "converted").alias("converted")).select(
        "total_predictions", "converted",
        F.round(guard_div("converted", "total_predictions") * 100, 1).alias("observed_conversion_rate"))


def _since(feedback: DataFrame, as_of: str, days: int) -> DataFrame:
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return feedback.where(ts("created_at") >= start)


def agent_action_breakdown(feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (_since(feedback, as_of, days).groupBy("agent_id", "action_taken")
            .agg(F.count(F.lit(1)).alias("count")))


def agent_performance(agents: DataFrame, feedback: DataFrame, assignments: DataFrame, as_of: str,
                      days: int = 30) -> DataFrame:
    f = (_since(feedback, as_of, days).groupBy("agent_id")
         .agg(F.count(F.lit(1)).alias("total_actions"),
              F.count_if(F.col("outcome") == "converted").alias("conversions")))
    a = assignments.groupBy("agent_id").agg(F.count(F.lit(1)).alias("assigned"))
    j = agents.select("agent_id").join(f, "agent_id", "left").join(a, "agent_id", "left").fillna(0)
    return j.select("agent_id", F.lit(days).alias("period_days"), "total_actions", "conversions",
                    (guard_div("conversions", "total_actions") * 100).alias("conversion_rate"),
                    F.round(guard_div("total_actions", "assigned") * 100, 2).alias("activation_rate"))


def agent_leaderboard(agents: DataFrame, feedback: DataFrame, as_of: str, days: int = 30, k: int = 10) -> DataFrame:
    f = _since(feedback, as_of, days).join(agents.select("agent_id", "name"), "agent_id")
    g = f.groupBy("agent_id", "name").agg(F.count(F.lit(1)).alias("total_actions"),
                                          F.count_if(F.col("outcome") == "converted").alias("conversions"))
    top = g.orderBy(F.col("total_actions").desc(), F.col("agent_id")).limit(k)
    return top.select("agent_id", "name", "total_actions", "conversions",
                      F.round(guard_div("conversions", "total_actions") * 100, 2).alias("conversion_rate"))


def prediction_log_stats(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    w = log.where(ts("timestamp") > start)
    return w.agg(F.count(F.lit(1)).alias("total_predictions"), F.avg("propensity_score").alias("avg_propensity"),
                 F.avg("response_time_ms").alias("avg_latency_ms"),
                 F.sum(F.col("cache_hit").cast("int")).alias("_hits")).select(
        "total_predictions", "avg_propensity", "avg_latency_ms",
        guard_div(F.coalesce("_hits", F.lit(0)), "total_predictions").alias("cache_hit_rate"))


SEGMENT_PROFILE_FEATURES = ["recency_days", "frequency", "monetary", "tenure_days", "num_products",
                            "engagement_score"]


def segment_profile(df: DataFrame, segment: str = "segment",
                    features: Sequence[str] = SEGMENT_PROFILE_FEATURES) -> DataFrame:
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("size"),
                                   *[F.avg(c).alias(c) for c in features],
                                   (F.avg("target") * 100).alias("avg_propensity"))


def label_balance(df: DataFrame, col: str = "target") -> DataFrame:
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))
    return g.crossJoin(F.broadcast(tot)).select(col, "count", (F.col("count") / F.col("_tot")).alias("share"))


def feedback_count_trigger(feedback: DataFrame, threshold: int = 10) -> DataFrame:
    return feedback.agg(F.count(F.lit(1)).alias("total_feedback")).select(
        "total_feedback", (F.col("total_feedback") >= threshold).alias("retrain_triggered"))


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_describe(df: DataFrame, cols: Sequence[str], quantile=None) -> DataFrame:
    """count, mean, std, min, quartiles, max per column in long format.

    The columns are unpivoted once to (column, value); every statistic is then a
    grouped aggregate over that long table, and the quartiles come from one
    grouped run of the exact, distributed quantile (a single pass for all
    columns, whatever their number).
    """
    from propel.functions.quantile import exact_quantiles
    quantile = quantile or exact_quantiles
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("_p")).select("_p.column", "_p.value")
    stats = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                       F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                       F.max("value").alias("max"))
    q = quantile(long, "value", [0.25, 0.5, 0.75], group=["column"]).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return stats.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
