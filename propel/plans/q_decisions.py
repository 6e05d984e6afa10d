"""Keyed queries: predicates (2.2), joins (2.3), windows (2.5), top-k (2.6), rules (2.10).

Most keys read the customer *profile*: customers + staged RFM matrix (with a
rating-derived engagement score) + the newest prediction per customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from propel.operators import decisions as dc
from propel.operators import features as ft
from propel.operators import ranking as rk
from propel.plans.q_features import AS_OF, RATING_FEATURES_SQL, _rfm_matrix_sql
from propel.plans.registry import AS_OF_EVENTS, DAYS, R, TS, query

# ---------------------------------------------------------------------------
# profile: Spark and SQL
# ---------------------------------------------------------------------------


def profile(t):
    freq = t.ratings().groupBy("user_id").agg(F.count("movie_id").alias("frequency"))
    eg = ft.engagement_log(freq).select(F.col("user_id").alias("customer_id"), "engagement_score")
    c = t.customers().join(eg, "customer_id", "left")
    m = ft.rfm_customer_features(c, t.transactions(), t.services(), t.claims(), t.lost_quotations(), AS_OF,
                                 keep=["name", "region", "products_owned_str"])
    return rk.latest_prediction(m, t.predictions())


PROFILE_CTES = _rfm_matrix_sql(
    True, engagement="eg.engagement_score",
    extra_ctes="""
eg0 AS (SELECT user_id, count(movie_id) AS n FROM ratings GROUP BY user_id),
eg AS (SELECT user_id AS customer_id, ln(1 + n) / ln(1 + (SELECT max(n) FROM eg0)) AS engagement_score FROM eg0),""",
    extra_join=" LEFT JOIN eg ON c.customer_id = eg.customer_id").rstrip() + """,
lp AS (SELECT customer_id, propensity_score AS latest_propensity_score, model_version AS latest_model_version,
              created_at AS last_prediction_at
       FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn
             FROM predictions) WHERE rn = 1),
profile AS (SELECT x.*, lp.latest_propensity_score, lp.latest_model_version, lp.last_prediction_at
            FROM x LEFT JOIN lp ON x.customer_id = lp.customer_id)
"""

S = "latest_propensity_score"


def on_profile(select_sql: str) -> str:
    return PROFILE_CTES + select_sql


def falsy_sql(c: str) -> str:
    return f"({c} IS NULL OR CAST({c} AS DOUBLE) = 0)"


def seg_by_score_sql(s: str = S) -> str:
    return f"CASE WHEN {s} > 0.7 THEN 0 WHEN {s} > 0.5 THEN 1 WHEN {s} > 0.3 THEN 2 ELSE 3 END"


def seg_by_value_sql(v: str = "monetary") -> str:
    return f"CASE WHEN {v} IS NULL THEN 0 WHEN {v} > 3.5 THEN 0 WHEN {v} > 2.5 THEN 1 WHEN {v} > 1.5 THEN 2 ELSE 3 END"


def map_sql(d: dict, key: str, default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in d.items())
    return f"CASE {key} {whens} ELSE '{default}' END"


def reasoning_short_sql(default: str = dc.REASONS_SHORT_DEFAULT) -> str:
    r = dc.REASONS_SHORT
    parts = [f"CASE WHEN NOT {falsy_sql('CAST(renewal_in_30_days AS INT)')} THEN '{r[0]}' END",
             f"CASE WHEN NOT {falsy_sql('had_claim_60d')} THEN '{r[1]}' END",
             f"CASE WHEN coalesce(engagement_score, 0) > 0.7 THEN '{r[2]}' END",
             f"CASE WHEN coalesce(monetary, 0) > 15000 THEN '{r[3]}' END"]
    txt = f"concat_ws(', ', {', '.join(parts)})"
    return f"CASE WHEN {txt} = '' THEN '{default}' ELSE {txt} END"


def reasoning_long_sql() -> str:
    r = dc.REASONS_LONG
    parts = [f"CASE WHEN NOT {falsy_sql('CAST(renewal_in_30_days AS INT)')} THEN '{r[0]}' END",
             f"CASE WHEN NOT {falsy_sql('had_claim_60d')} THEN '{r[1]}' END",
             f"CASE WHEN NOT {falsy_sql('days_since_service')} AND days_since_service < 90 THEN '{r[2]}' END",
             f"CASE WHEN NOT {falsy_sql('lost_quotation_count')} AND lost_quotation_count > 0 "
             f"THEN CAST(CAST(lost_quotation_count AS BIGINT) AS VARCHAR) || ' {r[3]}' END",
             f"CASE WHEN NOT {falsy_sql('engagement_score')} AND engagement_score > 0.7 THEN '{r[4]}' END",
             f"CASE WHEN NOT {falsy_sql('monetary')} AND monetary > 15000 THEN '{r[5]}' END"]
    txt = f"concat_ws(', ', {', '.join(parts)})"
    return f"CASE WHEN {txt} = '' THEN '{dc.REASONS_LONG_DEFAULT}' ELSE {txt} END"


def urgency_points_sql(s: str = S) -> str:
    return (f"((CASE WHEN {falsy_sql(s)} THEN 0.0 ELSE {s} * 5 END)"
            f" + (CASE WHEN {falsy_sql('CAST(renewal_in_30_days AS INT)')} THEN 0 ELSE 3 END)"
            f" + (CASE WHEN {falsy_sql('had_claim_60d')} THEN 0 ELSE 2 END)"
            f" + (CASE WHEN NOT {falsy_sql('days_since_service')} AND days_since_service < 30 THEN 1 ELSE 0 END))")


def urgency_level_sql(pts: str) -> str:
    return f"CASE WHEN {pts} >= 7 THEN 'high' WHEN {pts} >= 4 THEN 'medium' ELSE 'low' END"


def suggest_channel_sql(urg: str) -> str:
    return (f"CASE WHEN {urg} = 'high' THEN 'phone' WHEN NOT {falsy_sql('engagement_score')} "
            f"AND engagement_score > 0.6 THEN 'email' ELSE 'whatsapp' END")


# ---------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# ---------------------------------------------------------------------------
LOOKUP_ID = 42


@query("customer_lookup", on_profile(f"""
SELECT customer_id, {R(f'round({S} * 100, 1)', 'propensity_score')}, {seg_by_score_sql()} AS segment,
       {reasoning_short_sql()} AS reasoning
FROM profile WHERE customer_id = {LOOKUP_ID}"""))
def q_customer_lookup(t):
    p = profile(t).where(F.col("customer_id") == LOOKUP_ID)
    return p.select("customer_id", F.round(F.col(S) * 100, 1).alias("propensity_score"),
                    dc.segment_by_score(S).alias("segment"), dc.reasoning_short().alias("reasoning"))


@query("customers_in_list", """
SELECT customer_id, name FROM customers WHERE customer_id IN (SELECT customer_id FROM assignments)""")
def q_customers_in_list(t):
    return dc.customers_in_list(t.customers(), t.assignments()).select("customer_id", "name")


def _model_input_sql():
    def d(c, v):
        return f"CASE WHEN {falsy_sql(c)} THEN {v} ELSE {c} END AS {c}"
    arr = "string_split(products_owned_str, ',')"
    owns = ", ".join(f"coalesce(CAST(list_contains({arr}, '{p}') AS INT), 0) AS owns_{p}" for p in "ABC")
    return on_profile(f"""
SELECT customer_id, {d('recency_days', 9999)}, {d('frequency', 0)}, {R(f"CASE WHEN {falsy_sql('monetary')} THEN 0 ELSE monetary END", 'monetary')},
  {d('tenure_days', 0)},
  CASE WHEN products_owned_str IS NOT NULL AND len({arr}) > 0 THEN CAST(len({arr}) AS INTEGER) ELSE 1 END AS num_products,
  {R(f"CASE WHEN {falsy_sql('engagement_score')} THEN 0.5 ELSE engagement_score END", 'engagement_score')},
  {d('days_since_service', 9999)},
  CAST(NOT {falsy_sql('had_claim_60d')} AS INT) AS had_claim_60d,
  CAST(NOT {falsy_sql('CAST(renewal_in_30_days AS INT)')} AS INT) AS renewal_in_30_days,
  {d('lost_quotation_count', 0)}, {owns}
FROM profile""")


@query("model_input_project", _model_input_sql())
def q_model_input_project(t):
    p = profile(t).withColumn("products_owned", F.split("products_owned_str", ","))
    return dc.model_input_project(p)


FV_COLUMNS = ft.MODEL_COLUMNS + ["age", "competitor_price_avg"]


@query("feature_vector_default", on_profile(
    "SELECT customer_id, " + ", ".join(
        R(f"coalesce({c}, 0)", c) if c != "competitor_price_avg" else R("0", c) for c in FV_COLUMNS)
    + " FROM profile"))
def q_feature_vector_default(t):
    return dc.feature_vector_default(profile(t), FV_COLUMNS, keep=["customer_id"])


@query("campaign_target", on_profile(f"""
SELECT customer_id, {R(S, 'propensity_score')}, recency_days FROM profile WHERE {S} > 0.6 AND recency_days <= 180"""))
def q_campaign_target(t):
    p = profile(t)
    return p.where(dc.campaign_target(S, "recency_days")).select(
        "customer_id", F.col(S).alias("propensity_score"), "recency_days")


@query("churn_risk", f"""
WITH rf AS ({RATING_FEATURES_SQL})
SELECT user_id, recency_days, engagement_score, recency_days > 180 AND engagement_score < 50 AS churn_risk FROM rf""")
def q_churn_risk(t):
    rf = ft.rating_features(t.ratings())
    return rf.select("user_id", "recency_days", "engagement_score",
                     dc.churn_risk().alias("churn_risk"))


@query("high_propensity", on_profile(f"""
SELECT customer_id, {R(S, 'propensity_score')}, {S} > 0.7 AS high_propensity FROM profile"""))
def q_high_propensity(t):
    return profile(t).select("customer_id", F.col(S).alias("propensity_score"),
                             dc.high_propensity(S).alias("high_propensity"))


@query("prediction_coverage", on_profile(f"""
SELECT count(*) AS total_customers, count({S}) AS with_score, count(*) - count({S}) AS without_score,
       {R(f'round(count({S}) / greatest(count(*), 1) * 100, 1)', 'coverage_rate')}
FROM profile"""))
def q_prediction_coverage(t):
    p = profile(t)
    return p.agg(F.count(F.lit(1)).alias("total_customers"), F.count(S).alias("with_score"),
                 (F.count(F.lit(1)) - F.count(S)).alias("without_score"),
                 F.round(F.count(S) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1).alias("coverage_rate"))


@query("demo_target_rule", f"""
WITH rr AS (SELECT user_id, count(movie_id) AS frequency, avg(rating) AS monetary,
                   {DAYS('(SELECT max(date) FROM ratings)', 'max(date)')} AS recency_days FROM ratings GROUP BY user_id),
e AS (SELECT *, ln(1 + frequency) / ln(1 + (SELECT max(frequency) FROM rr)) AS engagement_score FROM rr)
SELECT user_id AS customer_id, recency_days, {R('monetary', 'monetary')}, {R('engagement_score', 'engagement_score')},
       CAST(engagement_score > 0.5 AND recency_days < 60 AND monetary >= 4.0 AS INT) AS target
FROM e""")
def q_demo_target_rule(t):
    r = ft.rating_as_rfm(t.ratings())
    return r.select("customer_id", "recency_days", "monetary", "engagement_score",
                    dc.demo_target_rule().alias("target"))


# ---------------------------------------------------------------------------
# 2.10 decision rules
# ---------------------------------------------------------------------------
@query("segment_by_value", f"""
SELECT user_id AS customer_id, {R('avg(rating)', 'monetary')}, {seg_by_value_sql('avg(rating)')} AS segment
FROM ratings GROUP BY user_id""")
def q_segment_by_value(t):
    r = ft.rating_as_rfm(t.ratings())
    return r.select("customer_id", "monetary", dc.segment_by_value("monetary").alias("segment"))


@query("segment_by_score", f"""
SELECT id, {R('propensity_score', 'propensity_score')}, {seg_by_score_sql('propensity_score')} AS segment,
  CASE WHEN propensity_score > 0.7 THEN 0 WHEN propensity_score > 0.5 THEN 1 ELSE 2 END AS segment_2cut
FROM predictions""")
def q_segment_by_score(t):
    p = t.predictions()
    return p.select("id", "propensity_score", dc.segment_by_score().alias("segment"),
                    dc.segment_by_score(three_cuts=False).alias("segment_2cut"))


@query("propensity_band", f"""
SELECT id, {R('round(propensity_score, 4)', 'propensity_score')},
  {R('round(propensity_score * 100, 2)', 'propensity_percentage')},
  CASE WHEN propensity_score < 0.25 THEN 'Low' WHEN propensity_score < 0.5 THEN 'Medium'
       WHEN propensity_score < 0.75 THEN 'High' ELSE 'Very High' END AS segment
FROM predictions""")
def q_propensity_band(t):
    p = t.predictions()
    return p.select("id", F.round("propensity_score", 4).alias("propensity_score"),
                    F.round(F.col("propensity_score") * 100, 2).alias("propensity_percentage"),
                    dc.propensity_band().alias("segment"))


def _action_sql(s="propensity_score"):
    a = dc.ACTION_TEXT
    return (f"CASE WHEN {s} > 0.75 THEN '{a[0]}' WHEN {s} > 0.5 THEN '{a[1]}' "
            f"WHEN {s} > 0.25 THEN '{a[2]}' ELSE '{a[3]}' END")


@query("recommended_action", f"""
SELECT id, {R('propensity_score', 'propensity_score')}, {_action_sql()} AS recommended_action FROM predictions""")
def q_recommended_action(t):
    p = t.predictions()
    return p.select("id", "propensity_score", dc.recommended_action().alias("recommended_action"))


@query("recommend_product", on_profile(f"""
SELECT customer_id, {seg_by_value_sql()} AS segment,
  {map_sql(dc.SEGMENT_PRODUCTS, seg_by_value_sql(), dc.DEFAULT_PRODUCT)} AS recommended_product,
  CASE WHEN {S} > 0.7 THEN 'Premium Bundle' ELSE 'Standard Upgrade' END AS product_by_score
FROM profile"""))
def q_recommend_product(t):
    p = profile(t).withColumn("segment", dc.segment_by_value("monetary"))
    return p.select("customer_id", "segment", dc.recommend_product("segment").alias("recommended_product"),
                    dc.recommend_product_by_score(S).alias("product_by_score"))


@query("recommend_channel", on_profile(f"""
SELECT customer_id, CASE WHEN {S} > 0.8 THEN 'Phone' WHEN coalesce(engagement_score, 0) > 0.6 THEN 'Email'
  ELSE 'WhatsApp' END AS recommended_channel FROM profile"""))
def q_recommend_channel(t):
    return profile(t).select("customer_id", dc.recommend_channel(S).alias("recommended_channel"))


@query("urgency_points", on_profile(f"""
SELECT customer_id, {R(urgency_points_sql(), 'urgency_points')}, {urgency_level_sql(urgency_points_sql())} AS urgency
FROM profile"""))
def q_urgency_points(t):
    pts = dc.urgency_points(S)
    return profile(t).select("customer_id", pts.alias("urgency_points"), dc.urgency_level(pts).alias("urgency"))


@query("suggest_channel", on_profile(f"""
SELECT customer_id, {suggest_channel_sql(urgency_level_sql(urgency_points_sql()))} AS suggested_channel FROM profile"""))
def q_suggest_channel(t):
    urg = dc.urgency_level(dc.urgency_points(S))
    return profile(t).select("customer_id", dc.suggest_channel(urg).alias("suggested_channel"))


@query("reasoning_short", on_profile(f"SELECT customer_id, {reasoning_short_sql()} AS reasoning FROM profile"))
def q_reasoning_short(t):
    return profile(t).select("customer_id", dc.reasoning_short().alias("reasoning"))


@query("reasoning_long", on_profile(f"SELECT customer_id, {reasoning_long_sql()} AS reasoning FROM profile"))
def q_reasoning_long(t):
    return profile(t).select("customer_id", dc.reasoning_long().alias("reasoning"))


QUEUE_K = 10


def _agent_queue_sql(k=QUEUE_K):
    pts = urgency_points_sql()
    urg = urgency_level_sql(pts)
    return on_profile(f""",
j AS (SELECT a.agent_id, p.*, row_number() OVER (PARTITION BY a.agent_id ORDER BY p.{S} DESC, p.customer_id) AS rank
      FROM assignments a JOIN profile p ON a.customer_id = p.customer_id
      WHERE a.agent_id IN (SELECT agent_id FROM agents) AND p.{S} > 0.2)
SELECT agent_id, rank, customer_id, {R(f'round({S}, 4)', 'propensity_score')},
       '{dc.QUEUE_PRODUCT_DEFAULT}' AS recommended_product, {urg} AS urgency, {reasoning_long_sql()} AS reasoning,
       {suggest_channel_sql(urg)} AS suggested_channel
FROM j WHERE rank <= {k}""".replace("\n,\n", ",\n", 1))


@query("agent_queue", _agent_queue_sql())
def q_agent_queue(t):
    return rk.agent_queue(t.agents(), t.assignments(), profile(t), k=QUEUE_K)


@query("segment_strategy", f"""
SELECT id, {seg_by_score_sql('propensity_score')} AS segment,
  {map_sql(dc.SEGMENT_NAMES_LONG, seg_by_score_sql('propensity_score'), 'Unknown')} AS segment_name,
  {map_sql(dc.SEGMENT_STRATEGIES, seg_by_score_sql('propensity_score'), dc.DEFAULT_STRATEGY)} AS strategy
FROM predictions""")
def q_segment_strategy(t):
    p = t.predictions().withColumn("segment", dc.segment_by_score())
    return p.select("id", "segment", *dc.segment_strategy("segment"))


# ---------------------------------------------------------------------------
# 2.6 top-k, 2.5 windows
# ---------------------------------------------------------------------------
TOP_K = 10


@query("recent_predictions", on_profile(f""",
top AS (SELECT * FROM profile WHERE {S} IS NOT NULL ORDER BY {S} DESC, customer_id LIMIT {TOP_K})
SELECT customer_id, name, {R(f'round({S} * 100, 1)', 'propensity_score')},
  {map_sql(dc.SEGMENT_NAMES, seg_by_score_sql(), 'Unknown')} AS segment,
  CASE WHEN {S} > 0.7 THEN 'Premium Bundle' ELSE 'Standard Upgrade' END AS recommended_product,
  CASE WHEN {S} > 0.8 THEN 'Phone' ELSE 'Email' END AS channel, {reasoning_short_sql()} AS reasoning
FROM top""".replace("\n,\n", ",\n", 1)))
def q_recent_predictions(t):
    p = profile(t).where(F.col(S).isNotNull())
    top = rk.global_topk(p, [F.col(S).desc(), F.col("customer_id").asc()], TOP_K, rank_col=None)
    seg = dc.segment_by_score(S)
    return top.select("customer_id", "name", F.round(F.col(S) * 100, 1).alias("propensity_score"),
                      dc.lookup(dc.SEGMENT_NAMES, seg, "Unknown").alias("segment"),
                      dc.recommend_product_by_score(S).alias("recommended_product"),
                      F.when(F.col(S) > 0.8, "Phone").otherwise("Email").alias("channel"),
                      dc.reasoning_short().alias("reasoning"))


@query("opportunity_queue", on_profile(f""",
top AS (SELECT *, row_number() OVER (ORDER BY {S} DESC, customer_id) AS rank FROM profile
        WHERE {S} IS NOT NULL ORDER BY {S} DESC, customer_id LIMIT {TOP_K})
SELECT rank, customer_id, name, {R(f'round({S} * 100, 1)', 'propensity_score')},
  CASE WHEN {S} > 0.8 THEN 'Phone' WHEN {S} > 0.6 THEN 'Email' ELSE 'WhatsApp' END AS channel,
  CASE WHEN {S} > 0.85 THEN 'Now' WHEN {S} > 0.7 THEN 'Today' ELSE 'This Week' END AS urgency,
  {reasoning_short_sql()} AS reasoning, (SELECT count(*) FROM profile) AS total_opportunities
FROM top""".replace("\n,\n", ",\n", 1)))
def q_opportunity_queue(t):
    p = profile(t)
    total = p.agg(F.count(F.lit(1)).alias("total_opportunities"))
    top = rk.global_topk(p.where(F.col(S).isNotNull()), [F.col(S).desc(), F.col("customer_id").asc()], TOP_K)
    s = F.col(S)
    return top.crossJoin(F.broadcast(total)).select(
        "rank", "customer_id", "name", F.round(s * 100, 1).alias("propensity_score"),
        F.when(s > 0.8, "Phone").when(s > 0.6, "Email").otherwise("WhatsApp").alias("channel"),
        F.when(s > 0.85, "Now").when(s > 0.7, "Today").otherwise("This Week").alias("urgency"),
        dc.reasoning_short().alias("reasoning"), "total_opportunities")


@query("queue_rank", on_profile(f""",
top AS (SELECT customer_id, {S} AS s FROM profile WHERE {S} IS NOT NULL ORDER BY {S} DESC, customer_id LIMIT {TOP_K})
SELECT customer_id, row_number() OVER (ORDER BY s DESC, customer_id) AS rank FROM top""".replace("\n,\n", ",\n", 1)))
def q_queue_rank(t):
    p = profile(t).where(F.col(S).isNotNull())
    return rk.global_topk(p, [F.col(S).desc(), F.col("customer_id").asc()], TOP_K).select("customer_id", "rank")


@query("agent_queue_topk", on_profile(f""",
j AS (SELECT a.agent_id, a.customer_id, p.{S},
             row_number() OVER (PARTITION BY a.agent_id ORDER BY p.{S} DESC, a.customer_id) AS rank
      FROM assignments a JOIN profile p ON a.customer_id = p.customer_id WHERE p.{S} IS NOT NULL)
SELECT agent_id, customer_id, {R(S, 'propensity_score')}, rank FROM j WHERE rank <= 5""".replace("\n,\n", ",\n", 1)))
def q_agent_queue_topk(t):
    j = t.assignments().join(profile(t).where(F.col(S).isNotNull()), "customer_id")
    top = rk.topk_per_group(j, ["agent_id"], [F.col(S).desc(), F.col("customer_id").asc()], 5)
    return top.select("agent_id", "customer_id", F.col(S).alias("propensity_score"), "rank")


@query("latest_prediction", on_profile(f"""
SELECT customer_id, {R(S, 'latest_propensity_score')}, latest_model_version, {TS('last_prediction_at', 'last_prediction_at')}
FROM profile"""))
def q_latest_prediction(t):
    return profile(t).select("customer_id", S, "latest_model_version", "last_prediction_at")


@query("prediction_history", f"""
SELECT * FROM (
  SELECT id, customer_id, {R('propensity_score', 'propensity_score')}, model_version, {TS('created_at', 'created_at')},
         row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rank FROM predictions)
WHERE rank <= 3""")
def q_prediction_history(t):
    return rk.prediction_history(t.predictions(), 3)


@query("feedback_running_trigger", f"""
SELECT id, {TS('created_at', 'created_at')},
  count(*) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_count,
  count(*) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 10 AS retrain_triggered
FROM feedback""")
def q_feedback_running_trigger(t):
    f = t.feedback().select("id", F.col("created_at").cast("timestamp").alias("created_at"))
    return rk.running_count_trigger(f, ["created_at", "id"], threshold=10)


@query("revenue_trend", """
WITH g AS (SELECT date_trunc('month', o_orderdate) AS bucket,
                  sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS b,
                  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS n
           FROM orders GROUP BY 1),
c AS (SELECT bucket, sum(b) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS baseline,
             sum(n) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS nba FROM g)
SELECT strftime(bucket, '%Y-%m-%d') AS date, round(baseline, 2) AS baseline, round(nba, 2) AS nba,
       round(nba - baseline, 2) AS uplift FROM c""")
def q_revenue_trend(t):
    return rk.revenue_trend(t.base("orders"), "monthly")


@query("daily_activity_series", f"""
WITH s AS (SELECT range AS bin FROM range(30)),
st AS (SELECT TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 30 DAY AS start),
p AS (SELECT {DAYS('created_at', '(SELECT start FROM st)')} AS bin, count(*) AS n FROM predictions GROUP BY 1),
f AS (SELECT {DAYS('created_at', '(SELECT start FROM st)')} AS bin, count(*) AS n FROM feedback GROUP BY 1)
SELECT strftime((SELECT start FROM st) + to_days(CAST(s.bin AS INT)), '%Y-%m-%d') AS date,
       coalesce(p.n, 0) AS predictions, coalesce(f.n, 0) AS feedback
FROM s LEFT JOIN p ON s.bin = p.bin LEFT JOIN f ON s.bin = f.bin""")
def q_daily_activity_series(t):
    return rk.daily_activity_series(t.predictions(), t.feedback(), AS_OF_EVENTS, 30)


def _positioned_ratings(t):
    li = t.base("lineitem")
    o = t.base("orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"),
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("movie_id"))


@query("first_n_users_prefix", """
WITH r AS (SELECT l_orderkey * 100 + l_linenumber AS pos, o_custkey AS user_id, l_partkey AS movie_id
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT user_id, min(pos) AS fp FROM r GROUP BY user_id),
c AS (SELECT max(fp) AS cut FROM (SELECT fp FROM f ORDER BY fp LIMIT 100))
SELECT pos, user_id, movie_id FROM r WHERE pos <= (SELECT cut FROM c)""")
def q_first_n_users_prefix(t):
    return rk.first_n_users_prefix(_positioned_ratings(t), 100)


# ---------------------------------------------------------------------------
# 2.3 joins
# ---------------------------------------------------------------------------
@query("feedback_agent_join", """
SELECT f.id, f.agent_id, a.name, f.action_taken, f.outcome FROM feedback f JOIN agents a ON f.agent_id = a.agent_id""")
def q_feedback_agent_join(t):
    # agents: a staff table; AQE turns this into a broadcast join when its
    # runtime size is under the threshold, else it stays a shuffle join
    return t.feedback().join(t.agents(), "agent_id").select("id", "agent_id", "name", "action_taken", "outcome")


@query("customer_name_lookup", """
WITH lp AS (SELECT customer_id, propensity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions)
  WHERE rn = 1)
SELECT lp.customer_id, coalesce(c.name, 'Customer ' || CAST(lp.customer_id AS VARCHAR)) AS name
FROM lp LEFT JOIN customers c ON lp.customer_id = c.customer_id""")
def q_customer_name_lookup(t):
    lp = rk.latest_per_key(t.predictions(), "customer_id", ["created_at", "id"], ["propensity_score"])
    j = lp.join(t.customers().select("customer_id", "name"), "customer_id", "left")
    return j.select("customer_id", F.coalesce("name", F.concat(F.lit("Customer "),
                                                               F.col("customer_id").cast("string"))).alias("name"))


@query("orphan_ids", """
SELECT 'rating_without_title' AS kind, movie_id FROM (SELECT DISTINCT movie_id FROM ratings) r
  WHERE NOT EXISTS (SELECT 1 FROM movies m WHERE m.movie_id = r.movie_id)
UNION ALL
SELECT 'title_never_rated' AS kind, movie_id FROM movies m
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.movie_id = m.movie_id)""")
def q_orphan_ids(t):
    r = t.ratings().select("movie_id").distinct()
    m = t.movies().select("movie_id")
    a = r.join(m, "movie_id", "left_anti").select(F.lit("rating_without_title").alias("kind"), "movie_id")
    b = m.join(r, "movie_id", "left_anti").select(F.lit("title_never_rated").alias("kind"), "movie_id")
    return a.unionByName(b)


@query("normalize_by_global", f"""
WITH rf AS ({RATING_FEATURES_SQL})
SELECT user_id, {R('total_ratings / (SELECT max(total_ratings) FROM rf)', 'frequency_norm')},
       {R('recency_days / ((SELECT max(recency_days) FROM rf) + 1)', 'recency_norm')}
FROM rf""")
def q_normalize_by_global(t):
    rf = ft.rating_features(t.ratings())
    j = ft.with_global(rf, _mt=F.max("total_ratings"), _mr=F.max("recency_days"))
    return j.select("user_id", (F.col("total_ratings") / F.col("_mt")).alias("frequency_norm"),
                    (F.col("recency_days") / (F.col("_mr") + 1)).alias("recency_norm"))


@query("attach_segments", f"""
WITH lp AS (SELECT customer_id, propensity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions)
  WHERE rn = 1),
sg AS (SELECT customer_id, {seg_by_score_sql('propensity_score')} AS segment,
              {map_sql(dc.SEGMENT_NAMES, seg_by_score_sql('propensity_score'), 'Unknown')} AS segment_name FROM lp)
SELECT c.customer_id, c.name, sg.segment, sg.segment_name FROM customers c LEFT JOIN sg ON c.customer_id = sg.customer_id""")
def q_attach_segments(t):
    lp = rk.latest_per_key(t.predictions(), "customer_id", ["created_at", "id"], ["propensity_score"])
    sg = lp.select("customer_id", dc.segment_by_score().alias("segment"))
    sg = sg.withColumn("segment_name", dc.lookup(dc.SEGMENT_NAMES, "segment", "Unknown"))
    return t.customers().select("customer_id", "name").join(sg, "customer_id", "left")


# ---------------------------------------------------------------------------
# 2.7 set operations
# ---------------------------------------------------------------------------
@query("union_rating_parts", """
SELECT user_id, movie_id, rating, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM ratings WHERE year(date) <= 1997
UNION ALL SELECT user_id, movie_id, rating, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM ratings WHERE year(date) BETWEEN 1998 AND 1999
UNION ALL SELECT user_id, movie_id, rating, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM ratings WHERE year(date) = 2000
UNION ALL SELECT user_id, movie_id, rating, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM ratings WHERE year(date) >= 2001""")
def q_union_rating_parts(t):
    r = t.ratings()
    y = F.year("date")
    parts = [r.where(y <= 1997), r.where(y.between(1998, 1999)), r.where(y == 2000), r.where(y >= 2001)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("distinct_recent_users", """
SELECT DISTINCT user_id FROM ratings
WHERE date >= (SELECT max(date) FROM ratings) - INTERVAL 180 DAY AND rating >= 4""")
def q_distinct_recent_users(t):
    r = ft.with_global(t.ratings(), _ref=F.max("date"))
    return (r.where((F.col("date") >= F.col("_ref") - F.make_dt_interval(F.lit(180))) & (F.col("rating") >= 4))
            .select("user_id").distinct())
