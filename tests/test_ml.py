"""Model keys: properties instead of exact values."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from propel.ml import models as ml
from propel.operators import features as ft
from propel.sources.tables import Tables

FEATURES = [c for c in ft.RATING_FEATURE_COLUMNS if c not in ("user_id", "cross_sell_propensity")]


@pytest.fixture(scope="module")
def table(spark):
    return ft.quantile_label(ft.rating_features(Tables(spark, SF_MID).ratings())).cache()


def test_train_learnable_and_repeatable(spark, table):
    m1 = ml.propensity_train(table, FEATURES, params={"n_estimators": 15})
    test = ml.split_columns(table, "user_id").where("is_test")
    assert ml.evaluate_auc(m1, test) > 0.7
    m2 = ml.propensity_train(table, FEATURES, params={"n_estimators": 15})
    a = ml.score(m1, test).select("user_id", "propensity_score").orderBy("user_id").collect()
    b = ml.score(m2, test).select("user_id", "propensity_score").orderBy("user_id").collect()
    assert a == b
    s = ml.propensity_score_batch(m1, table, FEATURES)
    assert s.count() == table.count()
    assert s.where("propensity_score < 0 OR propensity_score > 1").count() == 0
    imp = ml.feature_importance(m1, FEATURES)
    assert math.isclose(imp.agg(F.sum("importance")).first()[0], 1.0, abs_tol=1e-9)
    assert ml.importance_topk(imp, 5).count() == 5


def test_fallback_decision(spark, table):
    r = ml.propensity_decide(None, table.limit(3), FEATURES, "none", "2024-01-31 00:00:00").first()
    assert r.propensity_score == 0.6 and r.recommended_channel == "Email" and r.model_version == "fallback"
    assert ml.score(None, table).select(F.max("propensity_score")).first()[0] == 0.5


def test_kmeans_labels_all_rows(spark):
    rr = ft.rating_as_rfm(Tables(spark, SF_MID).ratings())
    cols = ["recency_days", "frequency", "monetary", "tenure_days", "num_products", "engagement_score"]
    segs, cost = ml.kmeans_segments(rr, cols, "customer_id", starts=3)
    assert segs.count() == rr.count()
    assert segs.select("segment").distinct().count() == 4
    named = ml.name_segments(rr.join(segs, "customer_id"))
    assert named.where(F.col("segment_name").isNull()).count() == 0


def test_attribution_is_additive(spark, table):
    coefs, intercept, means = ml.attribution_model(table, FEATURES)
    top = ml.feature_attribution_topk(table, FEATURES, coefs, means, "user_id", k=5)
    margin = sum((F.col(c) * b for c, b in zip(FEATURES, coefs)), F.lit(0.0))
    mean_margin = sum(b * m for b, m in zip(coefs, means))
    chk = table.select("user_id", (margin - F.lit(mean_margin)).alias("m")).join(top, "user_id")
    assert chk.where(F.abs(F.col("m") - F.col("total")) > 1e-6).count() == 0
    txt = ml.attribution_text(top).select("reasoning").first().reasoning
    assert "propensity by" in txt


def test_tune_and_folds(spark, table):
    t = ml.tune_params(table, FEATURES, n_trials=2,
                       ranges={**ml.TUNE_RANGES, "n_estimators": (3, 5), "max_depth": (2, 3)})
    assert t.count() == 2 and t.where("best").count() == 1
    cv = ml.cross_validate(table, FEATURES, folds=3, params={"n_estimators": 3})
    assert cv.count() == 3


def test_standardize_population(spark, table):
    z = ml.standardize(table, ["total_ratings"])
    r = z.agg(F.avg("total_ratings").alias("m"), F.stddev_pop("total_ratings").alias("s")).first()
    assert abs(r.m) < 1e-9 and math.isclose(r.s, 1.0, rel_tol=1e-9)


def test_keyed_runs_use_the_library_defaults(monkeypatch):
    from propel.plans import q_ml
    seen = []

    class T:
        sf_dir = "none"

        class spark:
            class sparkContext:
                applicationId = "defaults"

    monkeypatch.setattr(q_ml, "training_table", lambda t: "table")
    for name in ("propensity_train", "tune_params", "cross_validate"):
        monkeypatch.setattr(q_ml.ml, name, lambda *a, **k: seen.append((a, k)))
    monkeypatch.setattr(q_ml, "_MODELS", {})
    q_ml.trained(T)
    q_ml.q_tune_params(T)
    q_ml.q_cross_validate(T)
    assert seen == [(("table", q_ml.FEATURES), {})] * 3
