"""Propensity models, tuning, segmentation and attribution.

Boosted trees grow by grouped sums over the partitioned feature table
(:mod:`propel.ml.boosting`), segments by Spark ML; only model metadata (trees,
coefficients, a few parameters) is brought to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import fields

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.functions.core import md5_mod, safe_div
from propel.functions.prefix import running_sums
from propel.ml import boosting as gb
from propel.ml import parzen, shap
from propel.ml import segments as seg
from propel.operators import decisions as dc
from propel.session import materialize

# ---------------------------------------------------------------------------
# fixed values that must equal the reference: training configuration
# ---------------------------------------------------------------------------
TRAIN_PARAMS = {"n_estimators": 200, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8,
                "colsample_bytree": 0.8, "early_stopping_rounds": 20}
TUNE_RANGES = {"n_estimators": (100, 500), "max_depth": (3, 10), "learning_rate": (0.01, 0.3),
               "subsample": (0.6, 1.0), "colsample_bytree": (0.6, 1.0)}
TUNE_TRIALS = 20
CV_FOLDS = 5
KMEANS_K, KMEANS_STARTS, SEED = 4, 10, 42
SEGMENT_ORDER_NAMES = ["High-Value Loyalist", "Dormant Upsell", "Life-Stage Triggered", "Price-Sensitive"]
FALLBACK = {"propensity_score": 0.6, "segment": 0, "segment_name": "High-Value Loyalist",
            "recommended_product": "Standard Offer", "recommended_channel": "Email",
            "reasoning": "Fallback prediction (model unavailable)", "model_version": "fallback"}
TOPK_IMPORTANCE, TOPK_ATTRIBUTION, TOPK_TEXT = 15, 5, 3


def split_columns(df: DataFrame, key: str, test_pct: int = 20, valid_pct: int = 10) -> DataFrame:
    """Repeatable hash split: ``is_test`` (test_pct %) and, inside train, ``is_valid``."""
    b = md5_mod(F.col(key), 100)
    b2 = md5_mod(F.concat(F.col(key).cast("string"), F.lit("#v")), 100)
    return df.withColumn("is_test", b < test_pct).withColumn("is_valid", (b >= test_pct) & (b2 < valid_pct))


TEST_PCT, VALID_PCT, TUNE_VALID_PCT = 20, 10, 25


def spec(params: dict | None = None, seed: int = SEED, test_pct: int = TEST_PCT, valid_pct: int = VALID_PCT) -> gb.Spec:
    """Settings of one model on the train part of :func:`split_columns`."""
    known = {f.name for f in fields(gb.Spec)}
    p = {k: v for k, v in {**TRAIN_PARAMS, **(params or {})}.items() if k in known}
    return gb.Spec(**p, seed=seed, train=tuple(range(test_pct, 100)), valid=tuple(range(valid_pct)))


def _table(df: DataFrame, features: Sequence[str], label: str, key: str):
    cuts = gb.edges(df, features)
    return gb.binned(df, features, cuts, label, key), cuts


def propensity_train(df: DataFrame, features: Sequence[str], label: str = "target", key: str = "user_id",
                     params: dict | None = None, seed: int = SEED, binned: tuple | None = None) -> gb.Model:
    """Boosted trees on the train part (test rows held out; validation rows stop it after
    ``early_stopping_rounds`` rounds without gain and choose the number of trees).
    ``binned``: df's binned table, its cuts and its shared rows, where these are made."""
    table, cuts, shared = binned or (*_table(df, features, label, key), None)
    return gb.fit_models(table, gb.start([spec(params, seed)], features, cuts), shared=shared)[0].final()


def score(model: gb.Model | None, df: DataFrame, out: str = "propensity_score") -> DataFrame:
    """P(class 1) for every row; no model -> constant 0.5."""
    if model is None:
        return df.withColumn(out, F.lit(0.5))
    s = gb.margins(df, [model], df.columns)
    return s.withColumn(out, 1 / (1 + F.exp(-F.col("z")[0]))).drop("z")


def propensity_score_batch(model: gb.Model | None, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Score all rows and add the score segment (the field the caller reads)."""
    s = score(model, df.fillna(0, subset=[c for c in features if c in df.columns]))
    return s.withColumn("segment", dc.segment_by_score("propensity_score"))


def propensity_decide(model: gb.Model | None, df: DataFrame, features: Sequence[str], version: str,
                      as_of: str) -> DataFrame:
    """Score + segment + product + channel + model version + time; fallback row when no model."""
    if model is None:
        return df.select(*[c for c in df.columns],
                         *[F.lit(v).alias(k) for k, v in FALLBACK.items()],
                         F.lit(as_of).cast("timestamp").alias("prediction_timestamp"))
    s = score(model, df.fillna(0, subset=[c for c in features if c in df.columns]))
    group = dc.segment_by_value("monetary") if "monetary" in df.columns else F.lit(0)
    return (s.withColumn("propensity_score", F.round("propensity_score", 4))
            .withColumn("segment", group)
            .withColumn("segment_name", dc.lookup(dc.SEGMENT_NAMES, "segment", "Unknown"))
            .withColumn("recommended_product", dc.recommend_product("segment"))
            .withColumn("recommended_channel", dc.recommend_channel("propensity_score"))
            .withColumn("model_version", F.lit(version))
            .withColumn("prediction_timestamp", F.lit(as_of).cast("timestamp")))


def auc_by(df: DataFrame, group: str, label: str, score_col: str) -> DataFrame:
    """(group, auc): rank AUC of every group at once, tied scores counted half."""
    by = (df.where(F.col(score_col).isNotNull() & F.col(label).isNotNull()).groupBy(group, F.col(score_col).cast("double").alias("_s"))
          .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")))
    r = running_sums(materialize(by), ["_s"], ["_neg"], inclusive=False, group=[group])       # negatives below
    a = r.groupBy(group).agg(F.sum(F.col("_pos").cast("double") * (F.col("cum__neg") + 0.5 * F.col("_neg"))).alias("_u"),
                             F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return a.select(group, safe_div(F.col("_u"), F.col("_p").cast("double") * F.col("_n")).alias("auc"))


def evaluate_auc(model: gb.Model, df: DataFrame, label: str = "target") -> float:
    return aucs([model], df.withColumn("_who", F.lit(0)), label, "_who").get(0, float("nan"))


def aucs(models: list, df: DataFrame, label: str, who: str) -> dict[int, float]:
    """AUC of each model on the rows whose column ``who`` (a number or an array of numbers) names it."""
    z = gb.margins(df, models, [label, who])
    many = dict(df.dtypes)[who].startswith("array")
    z = z.withColumn("_m", F.explode(who) if many else F.col(who)).select("_m", label, F.expr("z[_m]").alias("_z"))
    return {r[0]: float(r.auc) if r.auc is not None else float("nan") for r in auc_by(z, "_m", label, "_z").collect()}   # a row a model


def tune_params(df: DataFrame, features: Sequence[str], label: str = "target", key: str = "user_id",
                n_trials: int = TUNE_TRIALS, seed: int = SEED, ranges: dict | None = None,
                generation: int = 5, first_rung: int = 25, survivors: int = 2) -> DataFrame:
    """Tree-structured Parzen search with successive halving, refit of the best, AUC on
    held-out rows. Trials come in generations that grow together: all to ``first_rung``
    rounds, then only the ``survivors`` best of a generation to their full number (or until
    patience ends them). Selection and report use different rows: a trial's AUC is that of
    the validation rows (a quarter of the train part), the winner's test AUC that of the test part."""
    table, cuts = _table(df, features, label, key)
    shared = gb.share(table, len(features))
    x = split_columns(df.select(key, label, *features), key, TEST_PCT, TUNE_VALID_PCT)
    valid = materialize(x.where("is_valid").select(label, *features))      # read once or twice a generation
    search, rows = parzen.Search(ranges or TUNE_RANGES, seed), []
    while len(rows) < n_trials:
        trials = search.propose(min(generation, n_trials - len(rows)))
        ms = gb.start([spec(t, seed, TEST_PCT, TUNE_VALID_PCT) for t in trials], features, cuts)
        ms = gb.fit_models(table, ms, first_rung, shared=shared)
        every = valid.withColumn("_who", F.sequence(F.lit(0), F.lit(len(ms) - 1)))
        got = aucs([m.final() for m in ms], every, label, "_who")
        best = sorted(range(len(ms)), key=lambda i: (-_known(got.get(i)), i))[:survivors]
        more = gb.fit_models(table, [ms[i] for i in best], shared=shared)
        for i, m in zip(best, more):
            ms[i] = m
        # the others have not grown since
        grown = aucs([m.final() for m in more], valid.withColumn("_who", F.sequence(F.lit(0), F.lit(len(more) - 1))), label, "_who")
        got = {**got, **{i: grown.get(k) for k, i in enumerate(best)}}
        search.tell(trials, [_known(got.get(i)) for i in range(len(ms))])
        rows += [(t, _known(got.get(i)), len(ms[i].trees)) for i, t in enumerate(trials)]
    best = max(range(len(rows)), key=lambda i: (rows[i][1], -i))
    model = propensity_train(df, features, label, key, rows[best][0], seed, (table, cuts, shared))
    if shared is not None:
        shared.unpersist()
    test_auc = evaluate_auc(model, x.where("is_test"), label)
    out = [(i, t["n_estimators"], t["max_depth"], float(t["learning_rate"]), float(t["subsample"]), float(t["colsample_bytree"]),
            float(v), int(n), i == best, float(test_auc) if i == best else None) for i, (t, v, n) in enumerate(rows)]
    return df.sparkSession.createDataFrame(
        out, "trial int, n_estimators int, max_depth int, learning_rate double, subsample double, "
             "colsample_bytree double, validation_auc double, rounds int, best boolean, test_auc double")


def _known(v) -> float:
    return 0.5 if v is None or math.isnan(v) else v


def cross_validate(df: DataFrame, features: Sequence[str], label: str = "target", key: str = "user_id",
                   folds: int = CV_FOLDS, params: dict | None = None, seed: int = SEED) -> DataFrame:
    """k-fold AUC (fold = md5 part of the key): one metric row per fold. All folds grow
    together; a tenth of each fold's train part stops it."""
    table, cuts = _table(df, features, label, key)
    base = spec(params, seed)
    specs = [gb.replace(base, train=tuple(a for a in range(gb.PARTS) if a % folds != f)) for f in range(folds)]
    models = [m.final() for m in gb.fit_models(table, gb.start(specs, features, cuts))]
    x = df.select(label, *features, (md5_mod(F.col(key), gb.PARTS) % folds).alias("_fold"))
    got = aucs(models, x, label, "_fold")
    return df.sparkSession.createDataFrame([(f, got.get(f)) for f in range(folds)], "fold int, auc double")


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population std (scikit-learn form); zero std -> 0."""
    g = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(g))
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) for c in cols]
    return j.select(*[F.col(k) for k in keep], *z)


def kmeans_segments(df: DataFrame, cols: Sequence[str], key: str, k: int = KMEANS_K, starts: int = KMEANS_STARTS,
                    seed: int = SEED, cats: Sequence[str] = (), gamma: float = 0.5) -> tuple[DataFrame, float]:
    """k-means on standardized columns, best of ``starts`` runs by cost; with categorical columns
    ``cats`` k-prototypes (``gamma`` per differing category). All starts share each pass."""
    z = standardize(df.fillna(0, subset=list(cols)), cols, keep=[key, *cats])
    return seg.segments(z, key, cols, cats, k, starts, seed, gamma)


def name_segments(df: DataFrame, segment: str = "segment", value: str = "monetary",
                  names: Sequence[str] = SEGMENT_ORDER_NAMES) -> DataFrame:
    """Order segments by mean value (highest first) and attach the names."""
    from pyspark.sql import Window
    means = df.groupBy(segment).agg(F.avg(value).alias("_mv"))
    ranked = means.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_mv").desc(), F.col(segment))))
    lut = dc.lit_map({i + 1: n for i, n in enumerate(names)})
    ranked = ranked.select(segment, lut[F.col("_r")].alias("segment_name"))
    return df.join(F.broadcast(ranked), segment, "left")  # one row per segment (k rows)


def feature_importance(model: gb.Model, features: Sequence[str]) -> DataFrame:
    """Gain importance per feature (sums to 1)."""
    from pyspark.sql import SparkSession
    by = dict(zip(model.features, model.gains().tolist()))
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()     # a thread of its own has no active one
    return spark.createDataFrame([(f, float(by.get(f, 0.0))) for f in features], "feature string, importance double")


def importance_topk(imp: DataFrame, k: int = TOPK_IMPORTANCE) -> DataFrame:
    return imp.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def attribution_model(df: DataFrame, features: Sequence[str], label: str = "target"):
    """Logistic model on standardized features; returns (coefficients, intercept, means, stds)."""
    g = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
               *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    means = [float(g[f"m_{c}"] or 0.0) for c in features]
    stds = [float(g[f"s_{c}"] or 0.0) or 1.0 for c in features]
    z = df.select(F.col(label).cast("double").alias("label"),
                  *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(features, means, stds)])
    v = VectorAssembler(inputCols=list(features), outputCol="features").transform(z)
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=100, regParam=0.0).fit(v)
    # coefficient per raw unit: beta_z / std
    coefs = [float(b) / s for b, s in zip(lr.coefficients.toArray().tolist(), stds)]
    return coefs, float(lr.intercept), means


def _by_size(contributions):
    """Largest absolute value first."""
    return F.array_sort(contributions, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                        .when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))


def feature_attribution_topk(df: DataFrame, features: Sequence[str], coefs: Sequence[float], means: Sequence[float],
                             key: str, k: int = TOPK_ATTRIBUTION) -> DataFrame:
    """Top-k signed contributions coef*(x - mean) per row (exact and additive:
    they sum to the row's margin minus the margin at the means)."""
    contrib = F.array(*[F.struct(F.lit(c).alias("feature"),
                                 (F.lit(b) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m))).alias("value"))
                        for c, b, m in zip(features, coefs, means)])
    ordered = _by_size(contrib)
    return df.select(F.col(key), F.aggregate(contrib, F.lit(0.0), lambda acc, x: acc + x["value"]).alias("total"),
                     F.slice(ordered, 1, k).alias("top_contributions"))


def tree_attribution_topk(df: DataFrame, model: gb.Model, key: str, k: int = TOPK_ATTRIBUTION) -> DataFrame:
    """(key, base, margin, total, top_contributions): top-k signed Shapley contributions of the
    scoring trees per row; ``total`` (the sum of all) is margin less base."""
    return shap.attributions(df, model, [key]).select(
        key, "base", "margin", F.aggregate("contributions", F.lit(0.0), lambda acc, x: acc + x["value"]).alias("total"),
        F.slice(_by_size("contributions"), 1, k).alias("top_contributions"))


def attribution_text(top: DataFrame, col: str = "top_contributions", n: int = TOPK_TEXT) -> DataFrame:
    """'<feature> increases|decreases propensity by 0.123' for the top n, joined by '; '."""
    parts = F.transform(F.slice(F.col(col), 1, n), lambda x: F.format_string(
        "%s %s propensity by %.3f", x["feature"], F.when(x["value"] > 0, "increases").otherwise("decreases"),
        F.abs(x["value"])))
    txt = F.array_join(parts, "; ")
    return top.withColumn("reasoning", F.when(F.size(F.col(col)) > 0, txt).otherwise("No dominant features"))
