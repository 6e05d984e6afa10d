"""Keyed queries: reports (2.4), validation (2.11), experiments and evaluation (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from propel.operators import decisions as dc
from propel.operators import experiments as ex
from propel.operators import features as ft
from propel.operators import reports as rp
from propel.operators import validation as vd
from propel.plans.q_decisions import S, on_profile, profile, seg_by_score_sql
from propel.plans.q_features import AS_OF, RFM_MATRIX_STAGED_SQL
from propel.session import unique_dir
from propel.plans.registry import AS_OF_EVENTS, DAYS, R, query
from propel.sources.tables import BASE_TABLES

DAYS_WINDOW = 7


def _seg_name_sql(score=S):
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in dc.SEGMENT_NAMES_LONG.items())
    return f"CASE {seg_by_score_sql(score)} {whens} END"


@query("segment_distribution", on_profile(f""",
segc AS (SELECT {_seg_name_sql()} AS segment_name, count(*) AS n FROM profile WHERE {S} IS NOT NULL GROUP BY 1),
names AS (SELECT * FROM (VALUES {', '.join(f"('{v}')" for v in dc.SEGMENT_NAMES_LONG.values())}) t(name))
SELECT names.name, CAST(coalesce(segc.n, 0) AS BIGINT) AS value FROM names LEFT JOIN segc ON names.name = segc.segment_name"""))
def q_segment_distribution(t):
    return rp.segment_distribution(profile(t))


@query("region_distribution", "SELECT region, count(*) AS count FROM customers GROUP BY region")
def q_region_distribution(t):
    return rp.region_distribution(t.customers())


def _map_text(col):
    """Map column -> 'k=v,...' sorted by key (engine-neutral text for the oracle)."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("string")))), ",")


@query("dashboard_summary", on_profile(f""",
m AS (SELECT *, {seg_by_score_sql()} AS segment FROM profile WHERE {S} IS NOT NULL),
tgt AS (SELECT count(*) AS total_customers,
          {R('round(avg(CAST((had_claim_60d * 0.3 + renewal_in_30_days * 0.3 + owns_B * 0.2 + CAST(income > 500000 AS INT) * 0.2) > 0.4 AS INT)) * 100, 1)', 'avg_propensity_score')}
        FROM m),
seg AS (SELECT string_agg(k || '=' || CAST(n AS VARCHAR), ',' ORDER BY k || '=' || CAST(n AS VARCHAR)) AS segment_distribution
        FROM (SELECT names.k, coalesce(c.n, 0) AS n FROM
               (SELECT * FROM (VALUES {', '.join(f"({i}, '{v}')" for i, v in dc.SEGMENT_NAMES.items())}) t(i, k)) names
               LEFT JOIN (SELECT segment, count(*) AS n FROM m GROUP BY segment) c ON names.i = c.segment)),
reg AS (SELECT string_agg(region || '=' || CAST(n AS VARCHAR), ',' ORDER BY region || '=' || CAST(n AS VARCHAR))
               AS region_distribution FROM (SELECT region, count(*) AS n FROM customers GROUP BY region))
SELECT * FROM tgt, seg, reg"""))
def q_dashboard_summary(t):
    m = profile(t).where(F.col(S).isNotNull()).withColumn("segment", dc.segment_by_score(S))
    out = rp.dashboard_summary(m, t.customers())
    return out.select("total_customers", "avg_propensity_score",
                      _map_text("segment_distribution").alias("segment_distribution"),
                      _map_text("region_distribution").alias("region_distribution"))


@query("dashboard_kpis", on_profile(f""",
c AS (SELECT count(*) AS total_customers, count({S}) AS predicted_customers, avg({S}) AS a FROM profile),
f AS (SELECT count(*) AS monthly_feedback, count_if(outcome = 'converted') AS monthly_conversions FROM feedback
      WHERE created_at >= date_trunc('month', TIMESTAMP '{AS_OF_EVENTS}'))
SELECT total_customers, predicted_customers,
  {R('round(predicted_customers / greatest(total_customers, 1) * 100, 1)', 'coverage_rate')},
  {R('round(coalesce(a, 0) * 100, 1)', 'average_propensity_score')}, monthly_feedback, monthly_conversions,
  {R('round(monthly_conversions / greatest(monthly_feedback, 1) * 100, 1)', 'conversion_rate')}
FROM c, f"""))
def q_dashboard_kpis(t):
    return rp.dashboard_kpis(profile(t), t.feedback(), AS_OF_EVENTS)


@query("conversion_funnel", on_profile(f""",
c AS (SELECT count(*) AS a, count({S}) AS b FROM profile),
f AS (SELECT count(*) AS c, count_if(outcome = 'converted') AS d FROM feedback),
j AS (SELECT * FROM c, f)
SELECT s.stage_order, s.stage, s.count,
  {R('round(b / greatest(a, 1) * 100, 1)', 'prediction_coverage')},
  {R('round(d / greatest(c, 1) * 100, 1)', 'conversion_rate')}
FROM j, (SELECT 1 AS stage_order, 'Total Customers' AS stage, a AS count FROM j UNION ALL
         SELECT 2, 'Predictions Made', b FROM j UNION ALL SELECT 3, 'Agent Actions', c FROM j UNION ALL
         SELECT 4, 'Conversions', d FROM j) s"""))
def q_conversion_funnel(t):
    return rp.conversion_funnel(profile(t), t.feedback())


@query("observed_conversion", f"""
SELECT count(*) AS total_predictions, count_if(outcome = 'converted') AS converted,
  {R("round(count_if(outcome = 'converted') / greatest(count(*), 1) * 100, 1)", 'observed_conversion_rate')}
FROM feedback""")
def q_observed_conversion(t):
    return rp.observed_conversion(t.feedback())


SINCE = f"created_at >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL {DAYS_WINDOW} DAY"


@query("agent_action_breakdown", f"""
SELECT agent_id, action_taken, count(*) AS count FROM feedback WHERE {SINCE} GROUP BY agent_id, action_taken""")
def q_agent_action_breakdown(t):
    return rp.agent_action_breakdown(t.feedback(), AS_OF_EVENTS, DAYS_WINDOW)


@query("agent_performance", f"""
WITH f AS (SELECT agent_id, count(*) AS total_actions, count_if(outcome = 'converted') AS conversions
           FROM feedback WHERE {SINCE} GROUP BY agent_id),
a AS (SELECT agent_id, count(*) AS assigned FROM assignments GROUP BY agent_id)
SELECT g.agent_id, {DAYS_WINDOW} AS period_days, coalesce(f.total_actions, 0) AS total_actions,
  coalesce(f.conversions, 0) AS conversions,
  {R('coalesce(f.conversions, 0) / greatest(coalesce(f.total_actions, 0), 1) * 100', 'conversion_rate')},
  {R('round(coalesce(f.total_actions, 0) / greatest(coalesce(a.assigned, 0), 1) * 100, 2)', 'activation_rate')}
FROM agents g LEFT JOIN f ON g.agent_id = f.agent_id LEFT JOIN a ON g.agent_id = a.agent_id""")
def q_agent_performance(t):
    return rp.agent_performance(t.agents(), t.feedback(), t.assignments(), AS_OF_EVENTS, DAYS_WINDOW)


@query("agent_leaderboard", f"""
SELECT f.agent_id, a.name, count(*) AS total_actions, count_if(f.outcome = 'converted') AS conversions,
  {R("round(count_if(f.outcome = 'converted') / greatest(count(*), 1) * 100, 2)", 'conversion_rate')}
FROM feedback f JOIN agents a ON f.agent_id = a.agent_id WHERE {SINCE}
GROUP BY f.agent_id, a.name ORDER BY total_actions DESC, f.agent_id LIMIT 10""")
def q_agent_leaderboard(t):
    return rp.agent_leaderboard(t.agents(), t.feedback(), AS_OF_EVENTS, DAYS_WINDOW, 10)


def prediction_log(t):
    """Prediction log rows: a prediction with its request's latency and cache flag."""
    rl = t.request_log().select(F.col("event_id").alias("id"), "duration_seconds", "cache_hit")
    return t.predictions().join(rl, "id").select(
        "id", "customer_id", "propensity_score", "model_version", F.col("created_at").alias("timestamp"),
        (F.col("duration_seconds") * 1000).alias("response_time_ms"), F.col("cache_hit").cast("int").alias("cache_hit"))


@query("prediction_log_stats", f"""
WITH l AS (SELECT p.propensity_score, p.created_at AS ts, r.duration_seconds * 1000 AS response_time_ms,
                  CAST(r.cache_hit AS INT) AS cache_hit FROM predictions p JOIN request_log r ON p.id = r.event_id)
SELECT count(*) AS total_predictions, {R('avg(propensity_score)', 'avg_propensity')},
  {R('avg(response_time_ms)', 'avg_latency_ms')},
  {R('coalesce(sum(cache_hit), 0) / greatest(count(*), 1)', 'cache_hit_rate')}
FROM l WHERE ts > TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 72 HOUR""")
def q_prediction_log_stats(t):
    return rp.prediction_log_stats(prediction_log(t), AS_OF_EVENTS, hours=72)


RATING_AS_RFM_BASE = f"""
r0 AS (SELECT *, max(date) OVER () AS ref FROM ratings),
g0 AS (SELECT user_id, max(date) AS last_d, min(date) AS first_d, any_value(ref) AS ref, count(movie_id) AS frequency,
             avg(rating) AS monetary, max(CAST(date >= ref - INTERVAL 180 DAY AND rating >= 4 AS INT)) AS target
      FROM r0 GROUP BY user_id),
rr AS (SELECT user_id AS customer_id, target, {DAYS('ref', 'last_d')} AS recency_days, frequency, monetary,
              {DAYS('last_d', 'first_d')} AS tenure_days, least(frequency, 50) AS num_products,
              ln(1 + frequency) / ln(1 + (SELECT max(frequency) FROM g0)) AS engagement_score FROM g0)"""


@query("segment_profile", f"""
WITH {RATING_AS_RFM_BASE}
SELECT CASE WHEN monetary IS NULL THEN 0 WHEN monetary > 3.5 THEN 0 WHEN monetary > 2.5 THEN 1
            WHEN monetary > 1.5 THEN 2 ELSE 3 END AS segment, count(*) AS size,
  {', '.join(R(f'avg({c})', c) for c in rp.SEGMENT_PROFILE_FEATURES)}, {R('avg(target) * 100', 'avg_propensity')}
FROM rr GROUP BY 1""")
def q_segment_profile(t):
    r = ft.rating_as_rfm(t.ratings()).withColumn("segment", dc.segment_by_value("monetary"))
    return rp.segment_profile(r)


DESCRIBE_COLS = ["total_ratings", "mean_rating", "std_rating", "recency_days", "engagement_score",
                 "cross_sell_propensity"]


def _describe_sql():
    from propel.plans.q_features import RATING_CORE_SQL
    prop = "coalesce(eng / 100.0 * 0.4 + is_active_6m * 0.3 + rating_consistency * 0.3, 0)"
    exprs = {"total_ratings": "total_ratings", "mean_rating": "mean_rating", "std_rating": "std_rating",
             "recency_days": "recency_days", "engagement_score": "coalesce(eng, 0)", "cross_sell_propensity": prop}
    parts = []
    for c in DESCRIBE_COLS:
        x = exprs[c]
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, {R(f'avg({x})', 'mean')},
  {R(f'stddev_samp({x})', 'std')}, {R(f'min({x})', 'min')}, {R(f'quantile_cont({x}, 0.25)', 'p25')},
  {R(f'quantile_cont({x}, 0.5)', 'p50')}, {R(f'quantile_cont({x}, 0.75)', 'p75')}, {R(f'max({x})', 'max')} FROM e""")
    return f"WITH {RATING_CORE_SQL}\n" + "\nUNION ALL\n".join(parts)


@query("feature_describe", _describe_sql())
def q_feature_describe(t):
    rf = ft.rating_features(t.ratings())
    return rp.feature_describe(rf, DESCRIBE_COLS)


@query("label_balance", f"""
WITH {RATING_AS_RFM_BASE}
SELECT target, count(*) AS count, {R('count(*) / (SELECT count(*) FROM rr)', 'share')} FROM rr GROUP BY target""")
def q_label_balance(t):
    return rp.label_balance(ft.rating_as_rfm(t.ratings()), "target")


@query("feedback_count_trigger", "SELECT count(*) AS total_feedback, count(*) >= 10 AS retrain_triggered FROM feedback")
def q_feedback_count_trigger(t):
    return rp.feedback_count_trigger(t.feedback())


@query("table_row_counts", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in BASE_TABLES))
def q_table_row_counts(t):
    return rp.table_row_counts({n: t.base(n) for n in BASE_TABLES})


# ---------------------------------------------------------------------------
# 2.11 validation
# ---------------------------------------------------------------------------
def _rule_sql(c, typ, kind, a, b):
    v = (f"(CASE WHEN TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) = floor(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) "
         f"THEN CAST(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS BIGINT) END)" if typ == "int"
         else f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)")
    if kind == "ge":
        ok = f"{v} >= {a}"
    elif kind == "range":
        ok = f"{v} BETWEEN {a} AND {b}"
    else:
        ok = f"{v} IN ({', '.join(map(str, a))})"
    return f"coalesce({ok}, false)"


def _validate_sql():
    sel = ", ".join(f"count_if(NOT {_rule_sql(*s)}) AS f{i}" for i, s in enumerate(vd.FEATURE_SCHEMA))
    rows = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", '{vd.rule_text(k, a, b)}' AS \"check\", f{i} AS failing_rows FROM one"
        for i, (c, t, k, a, b) in enumerate(vd.FEATURE_SCHEMA))
    return RFM_MATRIX_STAGED_SQL.replace("\nSELECT customer_id,\n", ",\nm AS (SELECT customer_id,\n", 1) + f"""),
one AS (SELECT {sel} FROM m),
rows AS ({rows})
SELECT *, failing_rows = 0 AS passed, (SELECT bool_and(failing_rows = 0) FROM rows) AS table_valid FROM rows"""


def feature_matrix(t):
    return ft.rfm_customer_features(t.customers(), t.transactions(), t.services(), t.claims(),
                                    t.lost_quotations(), AS_OF)


@query("validate_features", _validate_sql())
def q_validate_features(t):
    return vd.validate_features(feature_matrix(t))


def _failures_sql():
    parts = []
    for c, typ, k, a, b in vd.FEATURE_SCHEMA:
        val = (f"CAST({c} AS VARCHAR)" if typ == "int" else
               f"printf('%.6f', CAST({c} AS DOUBLE))")
        parts.append(f"SELECT customer_id, '{c}' AS \"column\", {val} AS value, '{vd.rule_text(k, a, b)}' AS \"check\" "
                     f"FROM m WHERE NOT {_rule_sql(c, typ, k, a, b)}")
    return RFM_MATRIX_STAGED_SQL.replace("\nSELECT customer_id,\n", ",\nm AS (SELECT customer_id,\n", 1) + ")\n" + \
        "\nUNION ALL\n".join(parts)


@query("validation_failures", _failures_sql())
def q_validation_failures(t):
    return vd.validation_failures(feature_matrix(t))


@query("check_titles", """
SELECT count(*) AS total_movies, count_if(TRY_CAST(CAST(movie_id AS VARCHAR) AS BIGINT) IS NULL) AS non_numeric_ids,
  count(DISTINCT CASE WHEN year < 1000 OR year > 2006 THEN year END) AS invalid_year_anomalies,
  count_if(TRY_CAST(CAST(movie_id AS VARCHAR) AS BIGINT) IS NULL) = 0
    AND count(DISTINCT CASE WHEN year < 1000 OR year > 2006 THEN year END) = 0 AS valid
FROM movies""")
def q_check_titles(t):
    return vd.check_titles(t.movies())


@query("request_rule_check", f"""
SELECT count(*) AS feedback_rows,
  count_if(NOT coalesce(regexp_matches(action_taken, '^({'|'.join(vd.ACTIONS)})$'), false)) AS bad_action,
  count_if(outcome IS NOT NULL AND NOT regexp_matches(outcome, '^({'|'.join(vd.OUTCOMES)})$')) AS bad_outcome,
  CAST(0 AS BIGINT) AS notes_too_long,
  (SELECT count_if(NOT coalesce(propensity_score BETWEEN 0 AND 1, false)) FROM predictions) AS bad_score
FROM feedback""")
def q_request_rule_check(t):
    return vd.request_rule_check(t.feedback(), t.predictions(), "propensity_score")


DRIFT_COLS = ft.MODEL_COLUMNS[:5]


@query("drift_means", RFM_MATRIX_STAGED_SQL.replace("\nSELECT customer_id,\n", ",\nm AS (SELECT customer_id,\n", 1)
       + ")\n" + "\nUNION ALL\n".join(
           f"SELECT '{c}' AS feature, {R(f'round(avg({c}), 2)', 'current_mean')}, "
           f"CASE WHEN avg({c}) > 0 THEN 'stable' ELSE 'warning' END AS status FROM m" for c in DRIFT_COLS))
def q_drift_means(t):
    return vd.drift_means(feature_matrix(t), DRIFT_COLS)


DRIFT_BASE_AS_OF = "2000-12-01 00:00:00"
DRIFT_COLS_RFM = ["frequency", "monetary", "recency_days"]


def _drift_sql():
    qs = [i / 10 for i in range(1, 10)]
    parts = []
    for c in DRIFT_COLS_RFM:
        edges = ", ".join(f"quantile_cont({c}, {q})" for q in qs)
        parts.append(f"""
SELECT '{c}' AS feature, {R(f'(SELECT avg({c}) FROM base)', 'baseline_mean')},
  {R(f'(SELECT stddev_samp({c}) FROM base)', 'baseline_std')}, {R(f'(SELECT avg({c}) FROM cur)', 'current_mean')},
  {R(f'((SELECT avg({c}) FROM cur) - (SELECT avg({c}) FROM base)) / (SELECT stddev_samp({c}) FROM base)', 'mean_shift_std')},
  {R('sum((pc - pb) * ln(pc / pb))', 'psi')}
FROM (
  SELECT s.bin, greatest(coalesce(b.p, 0), 1e-6) AS pb, greatest(coalesce(c.p, 0), 1e-6) AS pc
  FROM (SELECT range AS bin FROM range(10)) s
  LEFT JOIN (SELECT bin, count(*) / (SELECT count({c}) FROM base) AS p FROM (
      SELECT len(list_filter((SELECT [{edges}] FROM base), lambda e: CAST({c} AS DOUBLE) > e)) AS bin FROM base WHERE {c} IS NOT NULL)
      GROUP BY bin) b ON s.bin = b.bin
  LEFT JOIN (SELECT bin, count(*) / (SELECT count({c}) FROM cur) AS p FROM (
      SELECT len(list_filter((SELECT [{edges}] FROM base), lambda e: CAST({c} AS DOUBLE) > e)) AS bin FROM cur WHERE {c} IS NOT NULL)
      GROUP BY bin) c ON s.bin = c.bin)""")
    return f"""
WITH base AS (SELECT customer_id, count(*) AS frequency, sum(amount) AS monetary,
                     {DAYS(f"TIMESTAMP '{DRIFT_BASE_AS_OF}'", 'max(transaction_date)')} AS recency_days
              FROM transactions WHERE transaction_date < TIMESTAMP '{DRIFT_BASE_AS_OF}' GROUP BY customer_id),
cur AS (SELECT customer_id, count(*) AS frequency, sum(amount) AS monetary,
               {DAYS(f"TIMESTAMP '{AS_OF}'", 'max(transaction_date)')} AS recency_days
        FROM transactions GROUP BY customer_id)
""" + "\nUNION ALL\n".join(parts)


@query("drift_vs_baseline", _drift_sql())
def q_drift_vs_baseline(t):
    tr = t.transactions()
    base = ft.rfm_agg(tr.where(F.col("transaction_date") < F.lit(DRIFT_BASE_AS_OF).cast("timestamp_ntz")),
                      DRIFT_BASE_AS_OF)
    cur = ft.rfm_agg(tr, AS_OF)
    return vd.drift_vs_baseline(base, cur, DRIFT_COLS_RFM)


@query("drift_profile")
def q_drift_profile(t):
    """The baseline's profile is stored; the check reads profiles only."""
    tr = t.transactions()
    base = ft.rfm_agg(tr.where(F.col("transaction_date") < F.lit(DRIFT_BASE_AS_OF).cast("timestamp_ntz")), DRIFT_BASE_AS_OF)
    path = unique_dir(t.spark, "drift-profile")
    vd.drift_profile(base, DRIFT_COLS_RFM).write.parquet(path)
    return vd.drift_from_profiles(t.spark.read.parquet(path), vd.drift_profile(ft.rfm_agg(tr, AS_OF), DRIFT_COLS_RFM))


@query("sample_fraction", """
SELECT customer_id, name FROM customers
WHERE ('0x' || md5(CAST(customer_id AS VARCHAR)))::UHUGEINT % 100 < 10""")
def q_sample_fraction(t):
    return vd.sample_fraction(t.customers(), "customer_id", 0.1).select("customer_id", "name")


# ---------------------------------------------------------------------------
# 2.12 experiments and evaluation
# ---------------------------------------------------------------------------
AB_SQL = "CASE WHEN ('0x' || md5(CAST(customer_id AS VARCHAR)))::UHUGEINT % 100 < 10 THEN 'challenger' ELSE 'champion' END"


@query("ab_assign", f"SELECT customer_id, {AB_SQL} AS ab_version FROM customers")
def q_ab_assign(t):
    return ex.ab_assign(t.customers().select("customer_id"), "customer_id", 0.1)


@query("ab_report", f"""
SELECT {AB_SQL} AS ab_version, {R("avg(CAST(outcome = 'converted' AS DOUBLE))", 'conversion_rate')},
       count(*) AS sample_size
FROM feedback GROUP BY 1""")
def q_ab_report(t):
    f = t.feedback().select("customer_id", (F.col("outcome") == "converted").cast("int").alias("actual"))
    return ex.ab_report(ex.ab_assign(f, "customer_id", 0.1))


CONF_SQL = """SELECT count_if(label <> 1 AND score < 0.5) AS tn, count_if(label <> 1 AND score >= 0.5) AS fp,
  count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 1 AND score >= 0.5) AS tp FROM scored"""


@query("confusion_counts", CONF_SQL)
def q_confusion_counts(t):
    return ex.confusion_counts(t.scored())


def _report_sql():
    z = "coalesce({}, 0)"

    def d(a, b):
        return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"
    p1, r1 = z.format(d("tp", "tp + fp")), z.format(d("tp", "tp + fn"))
    p0, r0 = z.format(d("tn", "tn + fn")), z.format(d("tn", "tn + fp"))
    return f"""
WITH c AS ({CONF_SQL}),
m AS (SELECT *, {p0} AS p0, {r0} AS r0, {p1} AS p1, {r1} AS r1, tn + fp AS s0, tp + fn AS s1 FROM c),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM m)
SELECT {R('p0', 'precision_0')}, {R('r0', 'recall_0')}, {R('f0', 'f1_0')}, s0 AS support_0,
       {R('p1', 'precision_1')}, {R('r1', 'recall_1')}, {R('f1', 'f1_1')}, s1 AS support_1,
       {R('coalesce((tp + tn) / nullif(CAST(s0 + s1 AS DOUBLE), 0), 0)', 'accuracy')},
       {R('(p0 + p1) / 2', 'macro_precision')}, {R('(r0 + r1) / 2', 'macro_recall')}, {R('(f0 + f1) / 2', 'macro_f1')},
       {R('coalesce((p0 * s0 + p1 * s1) / nullif(CAST(s0 + s1 AS DOUBLE), 0), 0)', 'weighted_precision')},
       {R('coalesce((r0 * s0 + r1 * s1) / nullif(CAST(s0 + s1 AS DOUBLE), 0), 0)', 'weighted_recall')},
       {R('coalesce((f0 * s0 + f1 * s1) / nullif(CAST(s0 + s1 AS DOUBLE), 0), 0)', 'weighted_f1')},
       {R('r1', 'sensitivity')}, {R('r0', 'specificity')}
FROM f"""


@query("classification_report", _report_sql())
def q_classification_report(t):
    return ex.classification_report(ex.confusion_counts(t.scored()))


def _auc_sql(score="score", src="scored"):
    return f"""
WITH g AS (SELECT CAST({score} AS DOUBLE) AS s, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM {src}
           WHERE {score} IS NOT NULL AND label IS NOT NULL GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT {R('sum(pos * (below + 0.5 * neg)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0)', 'auc')},
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c"""


@query("auc_roc", _auc_sql())
def q_auc_roc(t):
    return ex.auc_roc(t.scored())


@query("model_compare", f"""
WITH a AS ({_auc_sql('score', 'scored')}),
b AS ({_auc_sql('score_b', "(SELECT d.doc_id, l.quality AS label, least(d.n_chars / 20000.0E0, 1.0E0) AS score_b FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")})
SELECT round(a.auc, 4) AS auc_current, round(b.auc, 4) AS auc_previous, round(round(a.auc, 4) - round(b.auc, 4), 4) AS auc_change
FROM a, b""")
def q_model_compare(t):
    d = t.base("documents").select("doc_id", "n_chars")
    lab = t.base("labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id").select(
        F.col("quality").alias("label"), F.least(F.col("n_chars") / F.lit(2000.0), F.lit(1.0)).alias("score"),
        F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("score_b"))
    return ex.model_compare(j, "label", "score", "score_b")


@query("train_test_split_strat", f"""
WITH x AS (SELECT *, ('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 13))::BIGINT AS h FROM (
  SELECT user_id AS customer_id, max(CAST(date >= (SELECT max(date) FROM ratings) - INTERVAL 180 DAY AND rating >= 4 AS INT)) AS target
  FROM ratings GROUP BY user_id)),
q AS (SELECT target, quantile_cont(CAST(h AS DOUBLE), 0.2) AS thr FROM x GROUP BY target)
SELECT x.customer_id, x.target, CASE WHEN x.h <= q.thr THEN 'test' ELSE 'train' END AS split
FROM x JOIN q ON x.target = q.target""")
def q_train_test_split_strat(t):
    y = ft.recent_high_rating_target_agg(t.ratings()).withColumnRenamed("user_id", "customer_id")
    return ex.train_test_split_strat(y, "customer_id", "target", 0.2).select("customer_id", "target", "split")
