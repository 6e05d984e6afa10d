"""A/B assignment and model evaluation, as aggregates.

AUC is computed exactly (Mann-Whitney with ties averaged) from counts per
distinct score: the scores are reduced by a shuffle on the score value,
then the negatives below each score come from the two-level running sum,
so no step sorts the whole column in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propel.functions.core import md5_mod, safe_div
from propel.functions.prefix import running_sums

CHAMPION, CHALLENGER = "champion", "challenger"


def ab_version(key, traffic_split: float = 0.1) -> Column:
    """int(md5(str(id)), 16) % 100 < split x 100 -> challenger."""
    return F.when(md5_mod(key, 100) < traffic_split * 100, CHALLENGER).otherwise(CHAMPION)


def ab_assign(df: DataFrame, key: str, traffic_split: float = 0.1) -> DataFrame:
    return df.withColumn("ab_version", ab_version(F.col(key), traffic_split))


def ab_report(outcomes: DataFrame, version: str = "ab_version", actual: str = "actual") -> DataFrame:
    """Per version: conversion rate (share of actual == 1) and sample size."""
    return outcomes.groupBy(version).agg(F.avg((F.col(actual) == 1).cast("double")).alias("conversion_rate"),
                                         F.count(F.lit(1)).alias("sample_size"))


def confusion_counts(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    return df.agg(F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
                  F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"))


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages,
    sensitivity and specificity from (tn, fp, fn, tp); 0 where undefined."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def z(x):
        return F.coalesce(x, F.lit(0.0))
    p1, r1 = z(safe_div(tp, tp + fp)), z(safe_div(tp, tp + fn))
    p0, r0 = z(safe_div(tn, tn + fn)), z(safe_div(tn, tn + fp))
    f1 = z(safe_div(2 * p1 * r1, p1 + r1))
    f0 = z(safe_div(2 * p0 * r0, p0 + r0))
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    return counts.select(
        p0.alias("precision_0"), r0.alias("recall_0"), f0.alias("f1_0"), s0.cast("long").alias("support_0"),
        p1.alias("precision_1"), r1.alias("recall_1"), f1.alias("f1_1"), s1.cast("long").alias("support_1"),
        z(safe_div(tp + tn, n)).alias("accuracy"),
        ((p0 + p1) / 2).alias("macro_precision"), ((r0 + r1) / 2).alias("macro_recall"),
        ((f0 + f1) / 2).alias("macro_f1"),
        z(safe_div(p0 * s0 + p1 * s1, n)).alias("weighted_precision"),
        z(safe_div(r0 * s0 + r1 * s1, n)).alias("weighted_recall"),
        z(safe_div(f0 * s0 + f1 * s1, n)).alias("weighted_f1"),
        r1.alias("sensitivity"), r0.alias("specificity"))


def auc_roc(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """One row: rank AUC with tied scores counted half (NULL when a class is absent)."""
    by_score = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                .groupBy(F.col(score).cast("double").alias("_s"))
                .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")))
    from propel.session import materialize
    by_score = materialize(by_score)  # read by the bucket bounds and the running sums
    r = running_sums(by_score, ["_s"], ["_neg"], buckets=buckets, inclusive=False)  # negatives below
    a = r.agg(F.sum(F.col("_pos").cast("double") * (F.col("cum__neg") + 0.5 * F.col("_neg"))).alias("_u"),
              F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return a.select(safe_div(F.col("_u"), F.col("_p").cast("double") * F.col("_n")).alias("auc"),
                    F.col("_p").alias("positives"), F.col("_n").alias("negatives"))


def model_compare(df: DataFrame, label: str, score_a: str, score_b: str) -> DataFrame:
    a = auc_roc(df, label, score_a).select(F.col("auc").alias("auc_current"))
    b = auc_roc(df, label, score_b).select(F.col("auc").alias("auc_previous"))
    return (a.crossJoin(b).select(F.round("auc_current", 4).alias("auc_current"),
                                  F.round("auc_previous", 4).alias("auc_previous"))
            .withColumn("auc_change", F.round(F.col("auc_current") - F.col("auc_previous"), 4)))


def split_key(key) -> Column:
    """A repeatable 52-bit integer from md5 of the key (exact as a double too)."""
    h = F.md5(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


def train_test_split_strat(df: DataFrame, key: str, label: str, test_size: float = 0.2) -> DataFrame:
    """Stratified, repeatable split: per class, rows whose md5 integer is at or
    below the class's exact test_size quantile of that integer form the test set."""
    from propel.functions.quantile import quantile
    x = df.withColumn("_h", split_key(key))
    thr = quantile(x, "_h", test_size, group=[label], alias="_thr")
    return (x.join(F.broadcast(thr), label)  # one row per class
            .withColumn("split", F.when(F.col("_h") <= F.col("_thr"), "test").otherwise("train"))
            .drop("_h", "_thr"))
