"""Keyed queries: rating and customer feature builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from propel.operators import chunks as ck
from propel.operators import features as ft
from propel.session import unique_dir
from propel.plans.registry import AS_OF_CUSTOMER, DAYS, R, TS, query

# Category patterns for the driver's part names (FIXTURES.md); the reference's
# own patterns match nothing there and are unit-tested separately.
FIXTURE_CATEGORY_PATTERNS = {
    "action": "hot|red",
    "drama": "old|cold",
    "comedy": "gizmo|widget",
    "scifi": "new|plate",
    "horror": "anvil|rod",
}
FIXTURE_YEARS = list(range(1995, 2002))  # of the SQL only; the queries take the years from the data
AS_OF = AS_OF_CUSTOMER

RATING_CORE_SQL = f"""
u AS (
  SELECT user_id, count(movie_id) AS total_ratings, count(DISTINCT movie_id) AS unique_movies,
         avg(rating) AS mean_rating, coalesce(stddev_samp(rating), 0) AS std_rating,
         min(rating) AS min_rating, max(rating) AS max_rating,
         {DAYS('max(date)', 'min(date)')} AS tenure_days, max(date) AS last_date
  FROM ratings GROUP BY user_id),
r AS (SELECT *, {DAYS('(SELECT max(last_date) FROM u)', 'last_date')} AS recency_days,
             greatest(tenure_days, 1) AS ten FROM u),
m AS (SELECT max(total_ratings) AS mt, max(recency_days) AS mr, max(ten) AS mten FROM r),
e AS (
  SELECT r.*, total_ratings / (ten + 1) AS rating_velocity,
         CAST(recency_days <= 180 AS INT) AS is_active_6m, CAST(recency_days <= 365 AS INT) AS is_active_1y,
         1.0 / (1.0 + std_rating) AS rating_consistency,
         (total_ratings / nullif(mt, 0) + (1 - recency_days / nullif(mr, 0)) + mean_rating / 5.0
          + least(greatest(ten / nullif(mten, 0), 0), 1)) / 4.0 * 100.0 AS eng
  FROM r, m)"""

RATING_FEATURES_SQL = f"""
WITH {RATING_CORE_SQL}
SELECT user_id, total_ratings, unique_movies, {R('mean_rating', 'mean_rating')}, {R('std_rating', 'std_rating')},
       min_rating, max_rating, tenure_days, recency_days, {R('rating_velocity', 'rating_velocity')},
       is_active_6m, is_active_1y, {R('rating_consistency', 'rating_consistency')},
       {R('coalesce(eng, 0)', 'engagement_score')},
       {R('coalesce(eng / 100.0 * 0.4 + is_active_6m * 0.3 + rating_consistency * 0.3, 0)', 'cross_sell_propensity')}
FROM e"""


@query("rating_features", RATING_FEATURES_SQL)
def q_rating_features(t):
    """Flagship: the 15-column rating feature set over all ratings."""
    return ft.rating_features(t.ratings())


USER_RATING_SQL = f"""
SELECT user_id, count(movie_id) AS total_ratings, count(DISTINCT movie_id) AS unique_movies,
       {R('avg(rating)', 'mean_rating')}, {R('stddev_samp(rating)', 'std_rating')},
       min(rating) AS min_rating, max(rating) AS max_rating,
       {TS('min(date)', 'first_rating_date')}, {TS('max(date)', 'last_rating_date')}
FROM ratings GROUP BY user_id"""


@query("user_rating_agg", USER_RATING_SQL)
def q_user_rating_agg(t):
    return ft.user_rating_agg(t.ratings())


@query("user_rating_chunks", USER_RATING_SQL)
def q_user_rating_chunks(t):
    """The same from stored states of one chunk per year (users span chunks)."""
    path = unique_dir(t.spark, "user-ratings")
    ck.write_chunks(t.ratings().withColumn("chunk", F.year("date")), path)
    return ck.read_merged(t.spark, path)


@query("rating_distribution", f"""
SELECT user_id,
  {R('count_if(rating = 5) / count(rating) * 100', 'rating_5star_pct')},
  {R('count_if(rating = 4) / count(rating) * 100', 'rating_4star_pct')},
  {R('count_if(rating = 3) / count(rating) * 100', 'rating_3star_pct')},
  {R('count_if(rating < 3) / count(rating) * 100', 'rating_12star_pct')},
  {R('coalesce(var_samp(rating), 0)', 'rating_variance')},
  {R('CASE WHEN count(rating) < 3 OR coalesce(var_samp(rating), 0) <= 0 THEN 0 ELSE skewness(rating) END',
     'rating_skew')}
FROM ratings GROUP BY user_id""")
def q_rating_distribution(t):
    return ft.rating_distribution(t.ratings())


def _flags_sql(patterns=FIXTURE_CATEGORY_PATTERNS):
    return ", ".join(f"CAST(coalesce(regexp_matches(title, '{p}', 'i'), false) AS INT) AS genre_{k}"
                     for k, p in patterns.items())


@query("title_category_flags", f"SELECT movie_id, {_flags_sql()} FROM movies")
def q_title_category_flags(t):
    return ft.title_category_flags(t.movies(), FIXTURE_CATEGORY_PATTERNS)


@query("ratings_with_category", f"""
SELECT r.user_id, r.movie_id, r.rating, {TS('r.date', 'date')}, f.genre_action, f.genre_drama,
       f.genre_comedy, f.genre_scifi, f.genre_horror
FROM ratings r LEFT JOIN (SELECT movie_id, {_flags_sql()} FROM movies) f ON r.movie_id = f.movie_id""")
def q_ratings_with_category(t):
    flags = ft.title_category_flags(t.movies(), FIXTURE_CATEGORY_PATTERNS)
    return ft.ratings_with_category(t.ratings(), flags)


def _category_pref_sql():
    parts = []
    for c in ft.CATEGORIES:
        parts += [R(f"coalesce(avg(CASE WHEN genre_{c} = 1 THEN rating END), 0)", f"{c}_avg_rating"),
                  f"count_if(genre_{c} = 1) AS {c}_count",
                  R(f"coalesce(avg(CASE WHEN genre_{c} = 1 THEN rating END), 0) / 5 * 100", f"{c}_preference")]
    return f"""
SELECT r.user_id, count(*) AS total_ratings, {', '.join(parts)}
FROM ratings r LEFT JOIN (SELECT movie_id, {_flags_sql()} FROM movies) f ON r.movie_id = f.movie_id
GROUP BY r.user_id"""


@query("category_preference", _category_pref_sql())
def q_category_preference(t):
    flags = ft.title_category_flags(t.movies(), FIXTURE_CATEGORY_PATTERNS)
    return ft.category_preference(t.ratings(), flags)


def _years_sql():
    return ", ".join(f"count_if(year(date) = {y}) AS y{y}" for y in FIXTURE_YEARS)


@query("yearly_activity", f"SELECT user_id, {_years_sql()} FROM ratings GROUP BY user_id")
def q_yearly_activity(t):
    return ft.yearly_activity(t.ratings())


@query("activity_trend", f"""
SELECT *, {R(f'(y{max(FIXTURE_YEARS)} - y{min(FIXTURE_YEARS)}) / (y{min(FIXTURE_YEARS)} + 1) * 100.0',
             'trend_growth')}
FROM (SELECT user_id, {_years_sql()} FROM ratings GROUP BY user_id)""")
def q_activity_trend(t):
    years = ft.rating_years(t.ratings())
    return ft.activity_trend(ft.yearly_activity(t.ratings(), years), years)


@query("early_adopter_flag", f"""
SELECT user_id, count(*) AS total_ratings,
       CAST(min(date) <= TIMESTAMP '{ft.EARLY_ADOPTER_CUTOFF}' AS INT) AS is_early_adopter
FROM ratings GROUP BY user_id""")
def q_early_adopter_flag(t):
    return ft.early_adopter_flag(t.ratings())


@query("temporal_segments", f"""
SELECT *, {R(f'(y{max(FIXTURE_YEARS)} - y{min(FIXTURE_YEARS)}) / (y{min(FIXTURE_YEARS)} + 1) * 100.0',
             'trend_growth')}
FROM (SELECT user_id, {_years_sql()}, count(*) AS total_ratings,
             CAST(min(date) <= TIMESTAMP '1995-06-30 00:00:00' AS INT) AS is_early_adopter
      FROM ratings GROUP BY user_id)""")
def q_temporal_segments(t):
    return ft.temporal_segments(t.ratings(), ft.rating_years(t.ratings()), cutoff="1995-06-30 00:00:00")


def _readiness_sql():
    pref_pos = " + ".join(f"CAST(p.{c}_preference > 0 AS INT)" for c in ft.CATEGORIES)
    return f"""
WITH {RATING_CORE_SQL},
rf AS (SELECT * FROM e),
cp AS ({_category_pref_sql()}),
j AS (SELECT rf.user_id, rf.total_ratings, rf.recency_days, rf.mean_rating, rf.tenure_days,
             ({pref_pos}) AS n_pos FROM rf JOIN cp p ON rf.user_id = p.user_id),
mx AS (SELECT max(total_ratings) AS mt, max(recency_days) AS mr, max(tenure_days) AS mten FROM j),
s AS (SELECT j.user_id,
        (total_ratings / nullif(mt, 0) * 0.25
         + least(greatest(1 - recency_days / (mr + 1), 0), 1) * 0.25
         + mean_rating / 5 * 0.20 + n_pos / 5.0 * 0.15
         + least(greatest(tenure_days / (mten + 1), 0), 1) * 0.15) * 100 AS score FROM j, mx)
SELECT user_id, {R('score', 'cross_sell_readiness')},
  CASE WHEN score > 0 AND score <= 25 THEN 'Low' WHEN score > 25 AND score <= 50 THEN 'Medium'
       WHEN score > 50 AND score <= 75 THEN 'High' WHEN score > 75 AND score <= 100 THEN 'Very High' END
  AS crosssell_segment
FROM s"""


def _readiness_input(t):
    rf = ft.rating_features(t.ratings()).select("user_id", "total_ratings", "recency_days", "mean_rating",
                                                "tenure_days")
    flags = ft.title_category_flags(t.movies(), FIXTURE_CATEGORY_PATTERNS)
    cp = ft.category_preference(t.ratings(), flags).select(
        "user_id", *[f"{c}_preference" for c in ft.CATEGORIES])
    return rf.join(cp, "user_id")


@query("readiness_score", _readiness_sql())
def q_readiness_score(t):
    s = ft.readiness_score(_readiness_input(t))
    return s.select("user_id", "cross_sell_readiness",
                    ft.readiness_segment().alias("crosssell_segment"))


@query("readiness_segment", f"""
WITH x AS ({_readiness_sql()})
SELECT crosssell_segment, count(*) AS users FROM x GROUP BY crosssell_segment""")
def q_readiness_segment(t):
    s = ft.readiness_score(_readiness_input(t))
    return (s.select(ft.readiness_segment().alias("crosssell_segment"))
            .groupBy("crosssell_segment").agg(F.count(F.lit(1)).alias("users")))


@query("quantile_label", f"""
WITH {RATING_CORE_SQL},
rf AS (SELECT user_id, coalesce(eng / 100.0 * 0.4 + is_active_6m * 0.3 + rating_consistency * 0.3, 0)
              AS cross_sell_propensity FROM e)
SELECT user_id, {R('cross_sell_propensity', 'cross_sell_propensity')},
       CAST(cross_sell_propensity >= (SELECT quantile_cont(cross_sell_propensity, 0.7) FROM rf) AS INT) AS target
FROM rf""")
def q_quantile_label(t):
    rf = ft.rating_features(t.ratings()).select("user_id", "cross_sell_propensity")
    return ft.quantile_label(rf)


@query("engagement_log", f"""
WITH g AS (SELECT user_id, count(movie_id) AS frequency FROM ratings GROUP BY user_id)
SELECT user_id, frequency, {R('ln(1 + frequency) / ln(1 + (SELECT max(frequency) FROM g))', 'engagement_score')}
FROM g""")
def q_engagement_log(t):
    g = t.ratings().groupBy("user_id").agg(F.count("movie_id").alias("frequency"))
    return ft.engagement_log(g)


RFM_SQL = f"""
SELECT customer_id, {TS('max(transaction_date)', 'last_transaction')}, count(transaction_date) AS frequency,
       {R('sum(amount)', 'monetary')}, {DAYS(f"TIMESTAMP '{AS_OF}'", 'max(transaction_date)')} AS recency_days
FROM transactions GROUP BY customer_id"""


@query("rfm_agg", RFM_SQL)
def q_rfm_agg(t):
    return ft.rfm_agg(t.transactions(), AS_OF)


@query("service_recency", f"""
SELECT customer_id, {TS('max(last_service_date)', 'last_service_date')},
       {DAYS(f"TIMESTAMP '{AS_OF}'", 'max(last_service_date)')} AS days_since_service
FROM services GROUP BY customer_id""")
def q_service_recency(t):
    return ft.service_recency(t.services(), AS_OF)


@query("claim_flag_60d", f"""
SELECT customer_id, {TS('max(last_claim_date)', 'last_claim_date')},
       CAST({DAYS(f"TIMESTAMP '{AS_OF}'", 'max(last_claim_date)')} <= 60 AS INT) AS had_claim_60d
FROM claims GROUP BY customer_id""")
def q_claim_flag_60d(t):
    return ft.claim_flag_60d(t.claims(), AS_OF)


@query("lost_quotation_agg", f"""
SELECT customer_id, count(*) AS lost_quotation_count, {R('avg(competitor_price)', 'competitor_price_avg')}
FROM lost_quotations GROUP BY customer_id""")
def q_lost_quotation_agg(t):
    return ft.lost_quotation_agg(t.lost_quotations())


def _rfm_matrix_sql(staged: bool = True, engagement: str = "0.5", extra_ctes: str = "",
                    extra_join: str = "") -> str:
    big = 9999
    if staged:  # substring test on the comma text
        owns = ", ".join(f"coalesce(CAST(contains(c.products_owned_str, '{p}') AS INT), 0) AS owns_{p}"
                         for p in "ABC") + ","
    else:  # element test on the list
        owns = ", ".join(f"coalesce(CAST(list_contains(string_split(c.products_owned_str, ','), '{p}') AS INT), 0)"
                         f" AS owns_{p}" for p in "ABC") + ","
    if staged:
        rec, freq, mon = (f"coalesce(r.recency_days, {big})", f"coalesce(r.frequency, {big})",
                          f"coalesce(r.monetary, {big})")
        ten = f"coalesce({DAYS(f'TIMESTAMP {chr(39)}{AS_OF}{chr(39)}', 'c.acquisition_date')}, {big})"
        svc = f"coalesce(s.days_since_service, {big})"
    else:
        rec, freq, mon = ("coalesce(r.recency_days, 0)", "coalesce(r.frequency, 0)", "coalesce(r.monetary, 0)")
        ten = f"coalesce({DAYS(f'TIMESTAMP {chr(39)}{AS_OF}{chr(39)}', 'c.acquisition_date')}, 0)"
        svc = "coalesce(s.days_since_service, 0)"
    return f"""
WITH r AS (SELECT customer_id, count(transaction_date) AS frequency, sum(amount) AS monetary,
                  {DAYS(f"TIMESTAMP '{AS_OF}'", 'max(transaction_date)')} AS recency_days
           FROM transactions GROUP BY customer_id),
s AS (SELECT customer_id, {DAYS(f"TIMESTAMP '{AS_OF}'", 'max(last_service_date)')} AS days_since_service
      FROM services GROUP BY customer_id),
cl AS (SELECT customer_id,
              CAST({DAYS(f"TIMESTAMP '{AS_OF}'", 'max(last_claim_date)')} <= 60 AS INT) AS had_claim_60d
       FROM claims GROUP BY customer_id),
l AS (SELECT customer_id, count(*) AS lost_quotation_count FROM lost_quotations GROUP BY customer_id),{extra_ctes}
x AS (
  SELECT c.customer_id, {rec} AS recency_days, {freq} AS frequency, {mon} AS monetary, {ten} AS tenure_days,
         CASE WHEN c.products_owned_str IS NULL THEN 1 ELSE CAST(len(string_split(c.products_owned_str, ',')) AS INTEGER) END
           AS num_products,
         {engagement} AS engagement_score, {svc} AS days_since_service, coalesce(cl.had_claim_60d, 0) AS had_claim_60d,
         CAST(c.renewal_in_30_days AS INT) AS renewal_in_30_days,
         coalesce(l.lost_quotation_count, 0) AS lost_quotation_count,
         {owns}
         c.age, c.income, c.name, c.region, c.products_owned_str
  FROM customers c LEFT JOIN r ON c.customer_id = r.customer_id{extra_join}
  LEFT JOIN s ON c.customer_id = s.customer_id LEFT JOIN cl ON c.customer_id = cl.customer_id
  LEFT JOIN l ON c.customer_id = l.customer_id)
"""


RFM_MATRIX_STAGED_SQL = _rfm_matrix_sql(True) + f"""
SELECT customer_id,
  CAST((had_claim_60d * 0.3 + renewal_in_30_days * 0.3 + owns_B * 0.2 + CAST(income > 500000 AS INT) * 0.2)
       > 0.4 AS INT) AS target,
  recency_days, frequency, {R('monetary', 'monetary')}, tenure_days, num_products,
  {R('engagement_score', 'engagement_score')}, days_since_service, had_claim_60d, renewal_in_30_days,
  lost_quotation_count, owns_A, owns_B, owns_C, age, {R('income', 'income')}
FROM x"""


@query("rfm_customer_features", RFM_MATRIX_STAGED_SQL)
def q_rfm_customer_features(t):
    return ft.rfm_customer_features(t.customers(), t.transactions(), t.services(), t.claims(),
                                    t.lost_quotations(), AS_OF)


@query("rfm_customer_features_zero", _rfm_matrix_sql(False) + f"""
SELECT recency_days, frequency, {R('monetary', 'monetary')}, tenure_days, num_products,
  {R('engagement_score', 'engagement_score')}, days_since_service, had_claim_60d, renewal_in_30_days,
  lost_quotation_count, owns_A, owns_B, owns_C, customer_id
FROM x""")
def q_rfm_customer_features_zero(t):
    c = t.customers().withColumn("products_owned", F.split("products_owned_str", ","))
    return ft.rfm_customer_features_zero(c, AS_OF, t.transactions(), t.services(), t.claims(),
                                         t.lost_quotations())


@query("enrich_left_chain", _rfm_matrix_sql(True) + """
SELECT customer_id, recency_days, frequency, days_since_service, had_claim_60d, lost_quotation_count FROM x""")
def q_enrich_left_chain(t):
    m = ft.rfm_customer_features(t.customers(), t.transactions(), t.services(), t.claims(),
                                 t.lost_quotations(), AS_OF)
    return m.select("customer_id", "recency_days", "frequency", "days_since_service", "had_claim_60d",
                    "lost_quotation_count")


@query("product_flags_text", """
SELECT customer_id,
  coalesce(CAST(contains(products_owned_str, 'A') AS INT), 0) AS owns_A,
  coalesce(CAST(contains(products_owned_str, 'B') AS INT), 0) AS owns_B,
  coalesce(CAST(contains(products_owned_str, 'C') AS INT), 0) AS owns_C,
  CASE WHEN products_owned_str IS NULL THEN 1 ELSE CAST(len(string_split(products_owned_str, ',')) AS INTEGER) END AS num_products
FROM customers""")
def q_product_flags_text(t):
    return t.customers().select("customer_id", *ft.product_flags_text("products_owned_str"))


@query("product_flags_array", """
SELECT customer_id,
  CASE WHEN products_owned_str IS NULL THEN 0 ELSE CAST(list_contains(string_split(products_owned_str, ','), 'A') AS INT) END AS owns_A,
  CASE WHEN products_owned_str IS NULL THEN 0 ELSE CAST(list_contains(string_split(products_owned_str, ','), 'B') AS INT) END AS owns_B,
  CASE WHEN products_owned_str IS NULL THEN 0 ELSE CAST(list_contains(string_split(products_owned_str, ','), 'C') AS INT) END AS owns_C,
  CASE WHEN products_owned_str IS NULL THEN 1 ELSE CAST(len(string_split(products_owned_str, ',')) AS INTEGER) END AS num_products
FROM customers""")
def q_product_flags_array(t):
    c = t.customers().withColumn("products_owned", F.split("products_owned_str", ","))
    return c.select("customer_id", *ft.product_flags_array("products_owned"))


@query("tenure_days", f"""
SELECT customer_id, coalesce({DAYS(f"TIMESTAMP '{AS_OF}'", 'acquisition_date')}, 0) AS tenure_days FROM customers""")
def q_tenure_days(t):
    c = t.customers()
    return c.select("customer_id", F.coalesce(ft.tenure_days(c, AS_OF), F.lit(0).cast("long")).alias("tenure_days"))


@query("weighted_target_rule", f"""
WITH x AS (SELECT c.customer_id, c.income, CAST(c.renewal_in_30_days AS INT) AS renewal_in_30_days,
             coalesce(cl.had_claim_60d, 0) AS had_claim_60d,
             coalesce(CAST(contains(c.products_owned_str, 'B') AS INT), 0) AS owns_B
           FROM customers c LEFT JOIN (SELECT customer_id, CAST({DAYS(f"TIMESTAMP '2000-01-01 00:00:00'", 'max(last_claim_date)')} <= 365 AS INT) AS had_claim_60d
                                       FROM claims GROUP BY customer_id) cl ON c.customer_id = cl.customer_id)
SELECT customer_id, CAST((had_claim_60d * 0.3 + renewal_in_30_days * 0.3 + owns_B * 0.2
                          + CAST(income > 5000 AS INT) * 0.2) > 0.4 AS INT) AS target FROM x""")
def q_weighted_target_rule(t):
    # parameters moved into the fixture's range (claims within a year of 2000-01-01,
    # income above 5,000) so that every branch of the rule is exercised
    c = t.customers()
    cl = ft.claim_flag_60d(t.claims(), "2000-01-01 00:00:00", window_days=365).select("customer_id", "had_claim_60d")
    x = (c.join(cl, "customer_id", "left")
         .select("customer_id", "income", F.col("renewal_in_30_days").cast("int").alias("renewal_in_30_days"),
                 F.coalesce("had_claim_60d", F.lit(0)).alias("had_claim_60d"),
                 ft.product_flags_text("products_owned_str")[1]))
    s = (F.col("had_claim_60d").cast("double") * 0.3 + F.col("renewal_in_30_days").cast("double") * 0.3
         + F.col("owns_B").cast("double") * 0.2 + (F.col("income") > 5000).cast("int").cast("double") * 0.2)
    return x.select("customer_id", (s > 0.4).cast("int").alias("target"))


@query("rating_as_rfm", f"""
WITH r AS (SELECT *, max(date) OVER () AS ref FROM ratings),
g AS (SELECT user_id, max(date) AS last_d, min(date) AS first_d, any_value(ref) AS ref, count(movie_id) AS frequency,
             avg(rating) AS monetary,
             max(CAST(date >= ref - INTERVAL 180 DAY AND rating >= 4 AS INT)) AS target
      FROM r GROUP BY user_id)
SELECT user_id AS customer_id, target, {DAYS('ref', 'last_d')} AS recency_days, frequency, {R('monetary', 'monetary')},
  {DAYS('last_d', 'first_d')} AS tenure_days, least(frequency, 50) AS num_products,
  {R('ln(1 + frequency) / ln(1 + (SELECT max(frequency) FROM g))', 'engagement_score')},
  {DAYS('ref', 'last_d')} AS days_since_service, 0 AS had_claim_60d, 0 AS renewal_in_30_days,
  0 AS lost_quotation_count, 0 AS owns_A, 0 AS owns_B, 0 AS owns_C
FROM g""")
def q_rating_as_rfm(t):
    return ft.rating_as_rfm(t.ratings())


@query("recent_high_rating_target", """
WITH ref AS (SELECT max(date) AS m FROM ratings)
SELECT user_id, max(CAST(date >= (SELECT m FROM ref) - INTERVAL 180 DAY AND rating >= 4 AS INT)) AS target
FROM ratings GROUP BY user_id""")
def q_recent_high_rating_target(t):
    a = ft.recent_high_rating_target(t.ratings())
    b = ft.recent_high_rating_target_agg(t.ratings())
    # both forms are computed; the output carries whether they agree per user
    return a.join(b.withColumnRenamed("target", "_t2"), "user_id").select(
        "user_id", F.when(F.col("target") == F.col("_t2"), F.col("target")).alias("target"))


@query("fill_with_means", f"""
WITH j AS (SELECT c.customer_id, r.frequency, r.monetary, r.recency_days
           FROM customers c LEFT JOIN (SELECT customer_id, count(*) AS frequency, sum(amount) AS monetary,
             {DAYS(f"TIMESTAMP '{AS_OF}'", 'max(transaction_date)')} AS recency_days
             FROM transactions GROUP BY customer_id) r ON c.customer_id = r.customer_id)
SELECT customer_id, {R('coalesce(frequency, (SELECT avg(frequency) FROM j))', 'frequency')},
       {R('coalesce(monetary, (SELECT avg(monetary) FROM j))', 'monetary')},
       {R('coalesce(recency_days, (SELECT avg(recency_days) FROM j))', 'recency_days')}
FROM j""")
def q_fill_with_means(t):
    r = ft.rfm_agg(t.transactions(), AS_OF).select("customer_id", "frequency", "monetary", "recency_days")
    j = t.customers().select("customer_id").join(r, "customer_id", "left")
    return ft.fill_with_means(j, ["frequency", "monetary", "recency_days"])
