"""Per-user / per-customer feature builders.

Every builder is one lazy plan: a hash aggregate on the entity key (partial
aggregation before the shuffle, so a hot user costs one map-side row per
partition), the few global maxima as a one-row aggregate cross-joined by
broadcast (R7), and narrow projections. No driver round trips.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.functions.core import elapsed_days, safe_div, ts

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
# Title keyword patterns of the reference (case-insensitive regex, substring match).
REFERENCE_CATEGORY_PATTERNS = {
    "action": "action|fight|war|battle|shoot|gun|spy|hero",
    "drama": "drama|family|story|life",
    "comedy": "comedy|funny|laugh|comic",
    "scifi": "scifi|sci-fi|future|space|aliens|robot|matrix",
    "horror": "horror|scary|evil|ghost|killer|dark|terror",
}
CATEGORIES = ("action", "drama", "comedy", "scifi", "horror")
EARLY_ADOPTER_CUTOFF = "2000-12-31 00:00:00"
RECENCY_NONE = 9999           # recency / service days when no event exists
ACTIVE_6M_DAYS, ACTIVE_1Y_DAYS = 180, 365
CLAIM_WINDOW_DAYS = 60
TARGET_WINDOW_DAYS = 180
PRODUCTS_CAP = 50
HIGH_INCOME = 500000
FEATURE_COLUMNS = ["recency_days", "frequency", "monetary", "tenure_days", "num_products",
                   "engagement_score", "days_since_service", "had_claim_60d", "renewal_in_30_days",
                   "lost_quotation_count", "owns_A", "owns_B", "owns_C", "age", "income"]
MODEL_COLUMNS = FEATURE_COLUMNS[:13]
RATING_FEATURE_COLUMNS = ["user_id", "total_ratings", "unique_movies", "mean_rating", "std_rating",
                          "min_rating", "max_rating", "tenure_days", "recency_days", "rating_velocity",
                          "is_active_6m", "is_active_1y", "rating_consistency", "engagement_score",
                          "cross_sell_propensity"]


def with_global(df: DataFrame, **aggs) -> DataFrame:
    """R7: attach one-row global aggregates (e.g. maxima) to every row.

    The aggregate is a single row by construction, so broadcasting it is
    size-bounded; the cross join against one row is a map-side projection.
    """
    g = df.agg(*[e.alias(k) for k, e in aggs.items()])
    return df.crossJoin(F.broadcast(g))


# ---------------------------------------------------------------------------
# rating aggregates
# ---------------------------------------------------------------------------
def user_rating_agg(ratings: DataFrame) -> DataFrame:
    """Exact per-user count, distinct movies, mean, sample std, min, max, first/last date."""
    return ratings.groupBy("user_id").agg(
        F.count("movie_id").alias("total_ratings"),
        F.countDistinct("movie_id").alias("unique_movies"),
        F.avg("rating").alias("mean_rating"),
        F.stddev_samp("rating").alias("std_rating"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.min(ts("date")).alias("first_rating_date"),
        F.max(ts("date")).alias("last_rating_date"))


def rating_features(ratings: DataFrame, materialize_users: bool = True) -> DataFrame:
    """The 15-column rating feature set (reference instant = newest rating).

    The per-user aggregate is the only pass over the ratings. It is
    checkpointed (reliably, into the shared checkpoint dir) so the global
    maxima below read the small user table instead of recomputing the
    ratings scan, join and shuffle once per maximum.
    """
    u = user_rating_agg(ratings)
    u = (u.withColumn("std_rating", F.coalesce("std_rating", F.lit(0.0)))
         .withColumn("tenure_days", elapsed_days("last_rating_date", "first_rating_date"))
         .withColumn("_tenure", F.greatest("tenure_days", F.lit(1))))
    if materialize_users:
        from propel.session import materialize
        u = materialize(u)
    # every global in one one-row aggregate (floor is monotone, so the largest
    # recency is the one of the oldest last rating)
    g = u.agg(F.max("last_rating_date").alias("_ref"), F.min("last_rating_date").alias("_oldest_last"),
              F.max("total_ratings").alias("_max_total"), F.max("_tenure").alias("_max_ten"))
    g = g.withColumn("_max_rec", elapsed_days("_ref", "_oldest_last"))
    u = u.crossJoin(F.broadcast(g))
    u = u.withColumn("recency_days", elapsed_days("_ref", "last_rating_date"))
    u = (u.withColumn("rating_velocity", F.col("total_ratings") / (F.col("_tenure") + 1))
         .withColumn("is_active_6m", (F.col("recency_days") <= ACTIVE_6M_DAYS).cast("int"))
         .withColumn("is_active_1y", (F.col("recency_days") <= ACTIVE_1Y_DAYS).cast("int"))
         .withColumn("rating_consistency", 1.0 / (1.0 + F.col("std_rating"))))
    comps = [safe_div("total_ratings", "_max_total"),
             1.0 - safe_div("recency_days", "_max_rec"),
             F.col("mean_rating") / 5.0,
             F.least(F.greatest(safe_div("_tenure", "_max_ten"), F.lit(0.0)), F.lit(1.0))]
    # NULL (pandas NaN) when a maximum is 0; the final fill turns it into 0
    eng = (comps[0] + comps[1] + comps[2] + comps[3]) / 4.0 * 100.0
    u = u.withColumn("engagement_score", eng)
    u = u.withColumn("cross_sell_propensity",
                     F.col("engagement_score") / 100.0 * 0.4 + F.col("is_active_6m") * 0.3
                     + F.col("rating_consistency") * 0.3)
    out = u.select(*RATING_FEATURE_COLUMNS)
    return out.fillna(0)


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """Share of 5/4/3/<3 stars (percent), sample variance and bias-corrected skew."""
    n = F.count("rating")
    g = ratings.groupBy("user_id").agg(
        (F.count_if(F.col("rating") == 5) / n * 100).alias("rating_5star_pct"),
        (F.count_if(F.col("rating") == 4) / n * 100).alias("rating_4star_pct"),
        (F.count_if(F.col("rating") == 3) / n * 100).alias("rating_3star_pct"),
        (F.count_if(F.col("rating") < 3) / n * 100).alias("rating_12star_pct"),
        F.var_samp("rating").alias("_var"),
        F.skewness("rating").alias("_g1"),
        n.alias("_n"))
    nn = F.col("_n").cast("double")
    skew = F.when((F.col("_n") < 3) | (F.col("_var") <= 0) | F.col("_g1").isNull(), F.lit(0.0)) \
        .otherwise(F.col("_g1") * F.sqrt(nn * (nn - 1)) / (nn - 2))
    return g.select("user_id", "rating_5star_pct", "rating_4star_pct", "rating_3star_pct",
                    "rating_12star_pct", F.coalesce("_var", F.lit(0.0)).alias("rating_variance"),
                    skew.alias("rating_skew"))


def title_category_flags(movies: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """0/1 category flags from case-insensitive regex patterns on the title."""
    patterns = patterns or REFERENCE_CATEGORY_PATTERNS
    flags = [F.coalesce(F.col("title").rlike(f"(?i){p}"), F.lit(False)).cast("int").alias(f"genre_{k}")
             for k, p in patterns.items()]
    return movies.select("movie_id", *flags)


def ratings_with_category(ratings: DataFrame, flags: DataFrame) -> DataFrame:
    """Ratings left-joined to title flags. No broadcast hint: the title table has
    no proven size bound, so AQE broadcasts it at runtime only when its measured
    size is under the broadcast threshold, and otherwise keeps a shuffle join."""
    return ratings.join(flags, "movie_id", "left")


def category_preference(ratings: DataFrame, flags: DataFrame,
                        categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Per user and category: mean rating, count, preference = mean/5*100 (0 when none)."""
    r = ratings_with_category(ratings, flags)
    aggs = [F.count(F.lit(1)).alias("total_ratings")]
    for c in categories:
        hit = F.col(f"genre_{c}") == 1
        aggs += [F.coalesce(F.avg(F.when(hit, F.col("rating"))), F.lit(0.0)).alias(f"{c}_avg_rating"),
                 F.count_if(hit).alias(f"{c}_count")]
    g = r.groupBy("user_id").agg(*aggs)
    return g.select("*", *[(F.col(f"{c}_avg_rating") / 5 * 100).alias(f"{c}_preference") for c in categories])


def rating_years(ratings: DataFrame) -> list[int]:
    """Distinct rating years (a handful of values; one small aggregate); rows without a date have none."""
    return sorted(r[0] for r in ratings.select(F.year(ts("date")).alias("y")).where("y IS NOT NULL").distinct().collect())


def yearly_activity(ratings: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """user x year rating counts pivoted on a year list, missing = 0. Without a
    list the distinct years are read first (one small aggregate: a calendar span)."""
    years = list(years) if years is not None else rating_years(ratings)
    y = ratings.select("user_id", F.year(ts("date")).alias("year"))
    aggs = [F.count_if(F.col("year") == yr).alias(f"y{yr}") for yr in years]
    return y.groupBy("user_id").agg(*aggs)


def activity_trend(yearly: DataFrame, years: Sequence[int]) -> DataFrame:
    """(last year - first year) / (first year + 1) * 100; 0 when only one year exists."""
    if len(years) >= 2:
        first, last = F.col(f"y{min(years)}"), F.col(f"y{max(years)}")
        trend = (last - first) / (first + 1) * 100.0
    else:
        trend = F.lit(0.0)
    return yearly.withColumn("trend_growth", trend.cast("double"))


def early_adopter_flag(ratings: DataFrame, cutoff: str = EARLY_ADOPTER_CUTOFF) -> DataFrame:
    """1 when the user's first rating is on or before the cutoff instant."""
    return ratings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_ratings"),
        (F.min(ts("date")) <= F.lit(cutoff).cast("timestamp")).cast("int").alias("is_early_adopter"))


def temporal_segments(ratings: DataFrame, years: Sequence[int],
                      cutoff: str = EARLY_ADOPTER_CUTOFF) -> DataFrame:
    """Pivoted yearly activity, trend, total and early-adopter flag in one aggregate."""
    y = ratings.select("user_id", F.year(ts("date")).alias("year"), ts("date").alias("_d"))
    aggs = [F.count_if(F.col("year") == yr).alias(f"y{yr}") for yr in years]
    aggs += [F.count(F.lit(1)).alias("total_ratings"),
             (F.min("_d") <= F.lit(cutoff).cast("timestamp")).cast("int").alias("is_early_adopter")]
    return activity_trend(y.groupBy("user_id").agg(*aggs), years)


def readiness_score(df: DataFrame) -> DataFrame:
    """Weighted 0-100 cross-sell readiness; parts whose columns are absent add nothing."""
    cols = df.columns
    glob = {}
    if "total_ratings" in cols:
        glob["_mt"] = F.max("total_ratings")
    if "recency_days" in cols:
        glob["_mr"] = F.max("recency_days")
    if "tenure_days" in cols:
        glob["_mten"] = F.max("tenure_days")
    if glob:
        df = with_global(df, **glob)
    score = F.lit(0.0)
    if "total_ratings" in cols:
        score = score + safe_div("total_ratings", "_mt") * 0.25
    if "recency_days" in cols:
        rec = 1 - F.col("recency_days") / (F.col("_mr") + 1)
        score = score + F.least(F.greatest(rec, F.lit(0.0)), F.lit(1.0)) * 0.25
    if "mean_rating" in cols:
        score = score + F.col("mean_rating") / 5 * 0.20
    prefs = [c for c in cols if "preference" in c]
    if prefs:
        n_pos = sum(((F.col(c) > 0).cast("int") for c in prefs), F.lit(0))
        score = score + n_pos / len(prefs) * 0.15
    if "tenure_days" in cols:
        loy = F.col("tenure_days") / (F.col("_mten") + 1)
        score = score + F.least(F.greatest(loy, F.lit(0.0)), F.lit(1.0)) * 0.15
    out = df.withColumn("cross_sell_readiness", score * 100)
    return out.drop(*[c for c in ("_mt", "_mr", "_mten") if c in out.columns])


def readiness_segment(score_col: str = "cross_sell_readiness"):
    """pd.cut bins (0,25] Low, (25,50] Medium, (50,75] High, (75,100] Very High; else NULL."""
    s = F.col(score_col)
    return (F.when((s > 0) & (s <= 25), "Low").when((s > 25) & (s <= 50), "Medium")
            .when((s > 50) & (s <= 75), "High").when((s > 75) & (s <= 100), "Very High"))


def quantile_label(df: DataFrame, col: str = "cross_sell_propensity", q: float = 0.7,
                   out: str = "target") -> DataFrame:
    """1 when col >= its exact q-quantile (linear interpolation), else 0."""
    from propel.functions.quantile import quantile
    g = quantile(df, col, q, alias="_q")  # one row, exact, distributed
    return (df.crossJoin(F.broadcast(g))
            .withColumn(out, (F.col(col) >= F.col("_q")).cast("int")).drop("_q"))


def fill_with_means(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL numeric -> column mean (one one-row aggregate, broadcast)."""
    num = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    cols = cols or [c for c, t in df.dtypes if t in num or t.startswith("decimal")]
    if not cols:
        return df
    g = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(g))
    sel = [F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c)
           for c in df.columns]
    return j.select(*sel)


# ---------------------------------------------------------------------------
# customer (RFM) aggregates
# ---------------------------------------------------------------------------
def rfm_agg(transactions: DataFrame, as_of: str | datetime) -> DataFrame:
    """Per customer: last date, frequency, monetary sum, recency days against as_of."""
    g = transactions.groupBy("customer_id").agg(
        F.max(ts("transaction_date")).alias("last_transaction"),
        F.count("transaction_date").alias("frequency"),
        F.sum("amount").alias("monetary"))
    return g.withColumn("recency_days", elapsed_days(F.lit(str(as_of)), "last_transaction"))


def service_recency(services: DataFrame, as_of) -> DataFrame:
    g = services.groupBy("customer_id").agg(F.max(ts("last_service_date")).alias("last_service_date"))
    return g.withColumn("days_since_service", elapsed_days(F.lit(str(as_of)), "last_service_date"))


def claim_flag_60d(claims: DataFrame, as_of, window_days: int = CLAIM_WINDOW_DAYS) -> DataFrame:
    g = claims.groupBy("customer_id").agg(F.max(ts("last_claim_date")).alias("last_claim_date"))
    return g.withColumn("had_claim_60d",
                        (elapsed_days(F.lit(str(as_of)), "last_claim_date") <= window_days).cast("int"))


def lost_quotation_agg(lost: DataFrame) -> DataFrame:
    return lost.groupBy("customer_id").agg(F.count(F.lit(1)).alias("lost_quotation_count"),
                                           F.avg("competitor_price").alias("competitor_price_avg"))


def product_flags_text(text_col: str = "products_owned_str") -> list:
    """owns_A/B/C by substring and product count from comma text; NULL text -> 0 flags, 1 product."""
    t = F.col(text_col)
    flags = [F.coalesce(t.contains(p).cast("int"), F.lit(0)).alias(f"owns_{p}") for p in "ABC"]
    n = F.when(t.isNull(), F.lit(1)).otherwise(F.size(F.split(t, ",", -1))).alias("num_products")
    return flags + [n]


def product_flags_array(arr_col: str = "products_owned") -> list:
    """Same from an array column; NULL (not a list) -> 0 flags, 1 product."""
    a = F.col(arr_col)
    flags = [F.when(a.isNull(), F.lit(0)).otherwise(F.array_contains(a, p).cast("int")).alias(f"owns_{p}")
             for p in "ABC"]
    n = F.when(a.isNull(), F.lit(1)).otherwise(F.size(a)).alias("num_products")
    return flags + [n]


def tenure_days(df: DataFrame, as_of, col: str = "acquisition_date"):
    """Days since acquisition (R1); absent column -> 0."""
    if col not in df.columns:
        return F.lit(0).cast("long")
    return elapsed_days(F.lit(str(as_of)), col)


def weighted_target_rule(claim="had_claim_60d", renewal="renewal_in_30_days", owns_b="owns_B",
                         income="income", threshold: float = 0.4):
    """0.3 claim + 0.3 renewal + 0.2 owns_B + 0.2 (income > 500,000) > 0.4 (same float order)."""
    s = (F.col(claim).cast("double") * 0.3 + F.col(renewal).cast("int").cast("double") * 0.3
         + F.col(owns_b).cast("double") * 0.2 + (F.col(income) > HIGH_INCOME).cast("int").cast("double") * 0.2)
    return (s > threshold).cast("int")


def rfm_customer_features(customers: DataFrame, transactions: DataFrame, services: DataFrame,
                          claims: DataFrame, lost: DataFrame, as_of, keep: Sequence[str] = ()) -> DataFrame:
    """The 17-column feature matrix with the staged fill of the batch pipeline.

    Stage fills (kept from the reference): after the RFM join every missing
    value is 9999 (so customers without a transaction get frequency and
    monetary 9999 too), after the service join 9999, after claims and lost
    quotations 0. ``engagement_score`` comes from the customer row when present,
    else a constant 0.5 (the reference draws it at random).
    """
    rfm = rfm_agg(transactions, as_of).select("customer_id", "recency_days", "frequency", "monetary")
    df = customers.join(rfm, "customer_id", "left")
    df = df.fillna(RECENCY_NONE, subset=["recency_days", "frequency", "monetary"])
    df = df.withColumn("tenure_days", F.coalesce(tenure_days(df, as_of), F.lit(RECENCY_NONE).cast("long")))
    if "products_owned_str" in df.columns:
        df = df.select("*", *product_flags_text("products_owned_str"))
    else:
        df = df.select("*", *[F.lit(0).alias(f"owns_{p}") for p in "ABC"], F.lit(1).alias("num_products"))
    svc = service_recency(services, as_of).select("customer_id", "days_since_service")
    df = df.join(svc, "customer_id", "left").fillna(RECENCY_NONE, subset=["days_since_service"])
    clm = claim_flag_60d(claims, as_of).select("customer_id", "had_claim_60d")
    df = df.join(clm, "customer_id", "left").fillna(0, subset=["had_claim_60d"])
    lq = lost_quotation_agg(lost).select("customer_id", "lost_quotation_count")
    df = df.join(lq, "customer_id", "left").fillna(0, subset=["lost_quotation_count"])
    if "engagement_score" not in df.columns:
        df = df.withColumn("engagement_score", F.lit(0.5))
    df = df.withColumn("renewal_in_30_days", F.coalesce(F.col("renewal_in_30_days").cast("int"), F.lit(0)))
    if "cross_sell_flag" in df.columns:
        target = F.col("cross_sell_flag").cast("int")
    else:
        target = weighted_target_rule()
    df = df.withColumn("target", target)
    return df.select("customer_id", "target", *FEATURE_COLUMNS, *keep)


def rfm_customer_features_zero(customers: DataFrame, as_of, transactions: DataFrame | None = None,
                               services: DataFrame | None = None, claims: DataFrame | None = None,
                               lost: DataFrame | None = None) -> DataFrame:
    """The service-side builder: optional inputs, absent table -> constants, NULL -> 0."""
    df = customers
    if transactions is not None:
        df = df.join(rfm_agg(transactions, as_of).select("customer_id", "recency_days", "frequency", "monetary"),
                     "customer_id", "left")
    else:
        df = df.select("*", F.lit(RECENCY_NONE).alias("recency_days"), F.lit(0).alias("frequency"),
                       F.lit(0).alias("monetary"))
    df = df.withColumn("tenure_days", tenure_days(df, as_of))
    if "products_owned" in df.columns:
        df = df.select("*", *product_flags_array("products_owned"))
    else:
        df = df.select("*", *[F.lit(0).alias(f"owns_{p}") for p in "ABC"], F.lit(1).alias("num_products"))
    if services is not None:
        df = df.join(service_recency(services, as_of).select("customer_id", "days_since_service"),
                     "customer_id", "left")
    else:
        df = df.withColumn("days_since_service", F.lit(RECENCY_NONE))
    if claims is not None:
        df = df.join(claim_flag_60d(claims, as_of).select("customer_id", "had_claim_60d"), "customer_id", "left")
    else:
        df = df.withColumn("had_claim_60d", F.lit(0))
    if lost is not None:
        df = df.join(lost_quotation_agg(lost).select("customer_id", "lost_quotation_count"), "customer_id", "left")
    else:
        df = df.withColumn("lost_quotation_count", F.lit(0))
    if "engagement_score" not in df.columns:
        df = df.withColumn("engagement_score", F.lit(0.5))
    if "renewal_in_30_days" not in df.columns:
        df = df.withColumn("renewal_in_30_days", F.lit(0))
    df = df.withColumn("renewal_in_30_days", F.col("renewal_in_30_days").cast("int"))
    return df.select(*MODEL_COLUMNS, "customer_id").fillna(0)


def engagement_log(df: DataFrame, freq: str = "frequency") -> DataFrame:
    """log1p(freq) / log1p(max freq)."""
    j = with_global(df, _mf=F.max(freq))
    return j.withColumn("engagement_score", safe_div(F.log1p(freq), F.log1p("_mf"))).drop("_mf")


def recent_high_rating_target(ratings: DataFrame, window_days: int = TARGET_WINDOW_DAYS,
                              min_rating: int = 4) -> DataFrame:
    """1 when the user has a rating >= 4 within window_days of the newest rating."""
    g = ratings.groupBy("user_id").agg(F.max(ts("date")).alias("_last"))
    ref = ratings.agg(F.max(ts("date")).alias("_ref"))
    cut = ratings.crossJoin(F.broadcast(ref)).where(
        (ts("date") >= F.col("_ref") - F.make_dt_interval(F.lit(window_days))) & (F.col("rating") >= min_rating))
    hit = cut.select("user_id").distinct().withColumn("target", F.lit(1))
    return g.join(hit, "user_id", "left").select("user_id", F.coalesce("target", F.lit(0)).alias("target"))


def recent_high_rating_target_agg(ratings: DataFrame, window_days: int = TARGET_WINDOW_DAYS,
                                  min_rating: int = 4) -> DataFrame:
    """Same target as a conditional max inside the user aggregate (no second pass)."""
    r = with_global(ratings.select("user_id", "rating", ts("date").alias("date")), _ref=F.max("date"))
    hit = (F.col("date") >= F.col("_ref") - F.make_dt_interval(F.lit(window_days))) & (F.col("rating") >= min_rating)
    return r.groupBy("user_id").agg(F.max(hit.cast("int")).alias("target"))


def rating_as_rfm(ratings: DataFrame, window_days: int = TARGET_WINDOW_DAYS) -> DataFrame:
    """Ratings mapped onto the RFM matrix. The reference's random columns are
    not carried over: service days = recency, the 0/1 flags and counts = 0."""
    r = ratings.select("user_id", "movie_id", "rating", ts("date").alias("date"))
    r = with_global(r, _ref=F.max("date"))
    hit = (F.col("date") >= F.col("_ref") - F.make_dt_interval(F.lit(window_days))) & (F.col("rating") >= 4)
    g = r.groupBy("user_id").agg(
        F.max("date").alias("_last"), F.min("date").alias("_first"), F.first("_ref").alias("_ref"),
        F.count("movie_id").alias("frequency"), F.avg("rating").alias("monetary"),
        F.max(hit.cast("int")).alias("target"))
    g = (g.withColumn("recency_days", elapsed_days("_ref", "_last"))
         .withColumn("tenure_days", elapsed_days("_last", "_first"))
         .withColumn("num_products", F.least("frequency", F.lit(PRODUCTS_CAP))))
    g = engagement_log(g)
    return g.select(F.col("user_id").alias("customer_id"), "target", "recency_days", "frequency", "monetary",
                    "tenure_days", "num_products", "engagement_score",
                    F.col("recency_days").alias("days_since_service"),
                    F.lit(0).alias("had_claim_60d"), F.lit(0).alias("renewal_in_30_days"),
                    F.lit(0).alias("lost_quotation_count"),
                    F.lit(0).alias("owns_A"), F.lit(0).alias("owns_B"), F.lit(0).alias("owns_C"))
