"""Decision rules on scored rows.

All rules are column expressions (CASE ladders, literal maps, concat_ws), so
they fuse into the projection of whatever plan feeds them: no UDF, no
extra stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propel.functions.core import col_, falsy, or_default

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
SEGMENT_NAMES = {0: "High-Value Loyalist", 1: "Dormant Upsell", 2: "Price-Sensitive", 3: "Life-Stage"}
SEGMENT_NAMES_LONG = {0: "High-Value Loyalist", 1: "Dormant Upsell Candidate",
                      2: "Price-Sensitive Switcher", 3: "Life-Stage Triggered"}
SEGMENT_STRATEGIES = {0: "Premium upsell via personal call",
                      1: "Re-engagement with targeted email campaigns",
                      2: "Price-matched competitive bundle offers",
                      3: "Life-event triggered cross-sell notifications"}
DEFAULT_STRATEGY = "Standard approach"
SEGMENT_PRODUCTS = {0: "Premium Investment Bundle", 1: "Extended Protection Plan",
                    2: "Competitive Match Package", 3: "Essential Upgrade"}
DEFAULT_PRODUCT = "Standard Offer"
ACTION_TEXT = ["Prioritize for premium cross-sell offers", "Recommend targeted cross-sell campaign",
               "Consider for nurture campaign", "Not recommended for immediate cross-sell"]
REASONS_SHORT = ["Policy renewal upcoming", "Recent claim activity", "High digital engagement",
                 "High customer value"]
REASONS_SHORT_DEFAULT = "Standard propensity assessment"
REASONS_LONG = ["Policy renewal in next 30 days", "Recent claim filed", "Recent service visit",
                "previous lost quotations", "High digital engagement", "High-value customer"]
REASONS_LONG_DEFAULT = "Customer ready for upsell opportunity"
QUEUE_PRODUCT_DEFAULT = "Standard Upgrade"
# model-input defaults when a stored value is falsy (R4)
MODEL_INPUT_DEFAULTS = {"recency_days": 9999, "engagement_score": 0.5, "days_since_service": 9999}


def lit_map(d: dict) -> Column:
    """Literal map column (small constant lookup, evaluated in codegen)."""
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def lookup(d: dict, key, default=None) -> Column:
    v = lit_map(d)[col_(key)]
    return F.coalesce(v, F.lit(default)) if default is not None else v


# ---- 2.2 predicates ---------------------------------------------------------
def model_input_project(df: DataFrame) -> DataFrame:
    """The 13 model inputs from stored customer rows with the service defaults (R4)."""
    def num(c, d=0):
        return or_default(c, d) if c in df.columns else F.lit(d)
    has_list = "products_owned" in df.columns
    prods = F.col("products_owned") if has_list else F.lit(None).cast("array<string>")
    nonempty = prods.isNotNull() & (F.size(prods) > 0)
    out = [F.col("customer_id"),
           num("recency_days", MODEL_INPUT_DEFAULTS["recency_days"]).alias("recency_days"),
           num("frequency").alias("frequency"),
           num("monetary").alias("monetary"),
           num("tenure_days").alias("tenure_days"),
           F.when(nonempty, F.size(prods)).otherwise(F.lit(1)).alias("num_products"),
           num("engagement_score", MODEL_INPUT_DEFAULTS["engagement_score"]).cast("double").alias("engagement_score"),
           num("days_since_service", MODEL_INPUT_DEFAULTS["days_since_service"]).alias("days_since_service"),
           (~falsy("had_claim_60d")).cast("int").alias("had_claim_60d"),
           (~falsy(F.col("renewal_in_30_days").cast("int"))).cast("int").alias("renewal_in_30_days"),
           num("lost_quotation_count").alias("lost_quotation_count")]
    for p in "ABC":
        out.append(F.coalesce(F.array_contains(prods, p), F.lit(False)).cast("int").alias(f"owns_{p}"))
    return df.select(*out)


def feature_vector_default(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model columns in order; absent column -> 0, NULL -> 0."""
    sel = [F.col(c) for c in keep]
    for c in columns:
        sel.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns
                   else F.lit(0.0).alias(c))
    return df.select(*sel)


def campaign_target(score="propensity_score", recency="recency_days") -> Column:
    return (col_(score) > 0.6) & (col_(recency) <= 180)


def churn_risk(recency="recency_days", engagement="engagement_score") -> Column:
    return (col_(recency) > 180) & (col_(engagement) < 50)


def high_propensity(score="propensity_score", cut: float = 0.7) -> Column:
    return col_(score) > cut


def demo_target_rule(engagement="engagement_score", recency="recency_days", value="monetary") -> Column:
    return ((col_(engagement) > 0.5) & (col_(recency) < 60) & (col_(value) >= 4.0)).cast("int")


# ---- 2.10 rules --------------------------------------------------------------
def segment_by_value(value="monetary") -> Column:
    v = col_(value)
    return (F.when(v.isNull(), 0).when(v > 3.5, 0).when(v > 2.5, 1).when(v > 1.5, 2).otherwise(3))


def segment_by_score(score="propensity_score", three_cuts: bool = True) -> Column:
    s = col_(score)
    e = F.when(s > 0.7, 0).when(s > 0.5, 1)
    return (e.when(s > 0.3, 2).otherwise(3)) if three_cuts else e.otherwise(2)


def propensity_band(score="propensity_score") -> Column:
    s = col_(score)
    return F.when(s < 0.25, "Low").when(s < 0.5, "Medium").when(s < 0.75, "High").otherwise("Very High")


def recommended_action(score="propensity_score") -> Column:
    s = col_(score)
    return (F.when(s > 0.75, ACTION_TEXT[0]).when(s > 0.5, ACTION_TEXT[1])
            .when(s > 0.25, ACTION_TEXT[2]).otherwise(ACTION_TEXT[3]))


def recommend_product(segment="segment") -> Column:
    return lookup(SEGMENT_PRODUCTS, segment, DEFAULT_PRODUCT)


def recommend_product_by_score(score="propensity_score") -> Column:
    return F.when(col_(score) > 0.7, "Premium Bundle").otherwise("Standard Upgrade")


def recommend_channel(score="propensity_score", engagement="engagement_score") -> Column:
    return (F.when(col_(score) > 0.8, "Phone")
            .when(F.coalesce(col_(engagement), F.lit(0.0)) > 0.6, "Email").otherwise("WhatsApp"))


def urgency_points(score="propensity_score", renewal="renewal_in_30_days", claim="had_claim_60d",
                   service="days_since_service") -> Column:
    s = col_(score)
    pts = (F.when(falsy(s), 0.0).otherwise(s * 5)
           + F.when(falsy(col_(renewal).cast("int")), 0).otherwise(3)
           + F.when(falsy(claim), 0).otherwise(2)
           + F.when(~falsy(service) & (col_(service) < 30), 1).otherwise(0))
    return pts


def urgency_level(points: Column) -> Column:
    return F.when(points >= 7, "high").when(points >= 4, "medium").otherwise("low")


def suggest_channel(urgency: Column, engagement="engagement_score") -> Column:
    return (F.when(urgency == "high", "phone")
            .when(~falsy(engagement) & (col_(engagement) > 0.6), "email").otherwise("whatsapp"))


def reasoning_short(renewal="renewal_in_30_days", claim="had_claim_60d", engagement="engagement_score",
                    value="monetary", default: str = REASONS_SHORT_DEFAULT, percent_of=None) -> Column:
    """Up to four reasons joined by ', '. With ``percent_of`` (a score column) the
    fallback text is ``Propensity: NN%`` (the prediction-service form)."""
    parts = [F.when(~falsy(col_(renewal).cast("int")), REASONS_SHORT[0]),
             F.when(~falsy(claim), REASONS_SHORT[1]),
             F.when(F.coalesce(col_(engagement), F.lit(0)) > 0.7, REASONS_SHORT[2]),
             F.when(F.coalesce(col_(value), F.lit(0)) > 15000, REASONS_SHORT[3])]
    txt = F.concat_ws(", ", *parts)
    fallback = (F.format_string("Propensity: %.0f%%", col_(percent_of) * 100) if percent_of is not None
                else F.lit(default))
    return F.when(txt == "", fallback).otherwise(txt)


def reasoning_long(renewal="renewal_in_30_days", claim="had_claim_60d", service="days_since_service",
                   lost="lost_quotation_count", engagement="engagement_score", value="monetary") -> Column:
    parts = [F.when(~falsy(col_(renewal).cast("int")), REASONS_LONG[0]),
             F.when(~falsy(claim), REASONS_LONG[1]),
             F.when(~falsy(service) & (col_(service) < 90), REASONS_LONG[2]),
             F.when(~falsy(lost) & (col_(lost) > 0),
                    F.concat(col_(lost).cast("long").cast("string"), F.lit(" " + REASONS_LONG[3]))),
             F.when(~falsy(engagement) & (col_(engagement) > 0.7), REASONS_LONG[4]),
             F.when(~falsy(value) & (col_(value) > 15000), REASONS_LONG[5])]
    txt = F.concat_ws(", ", *parts)
    return F.when(txt == "", F.lit(REASONS_LONG_DEFAULT)).otherwise(txt)


def segment_strategy(segment="segment") -> list[Column]:
    return [lookup(SEGMENT_NAMES_LONG, segment, "Unknown").alias("segment_name"),
            lookup(SEGMENT_STRATEGIES, segment, DEFAULT_STRATEGY).alias("strategy")]


def decide(df: DataFrame, score="propensity_score") -> DataFrame:
    """Full decision row: segment, product, channel, band, action."""
    seg = segment_by_value("monetary") if "monetary" in df.columns else F.lit(0)
    return (df.withColumn("segment", seg)
            .withColumn("segment_name", lookup(SEGMENT_NAMES, "segment", "Unknown"))
            .withColumn("recommended_product", recommend_product("segment"))
            .withColumn("recommended_channel", recommend_channel(score))
            .withColumn("propensity_band", propensity_band(score))
            .withColumn("recommended_action", recommended_action(score)))


def customers_in_list(df: DataFrame, ids, key: str = "customer_id", max_literal: int = 1000) -> DataFrame:
    """Rows whose key is in ``ids``: a short Python list becomes an ``isin``
    predicate (pushed to the scan); a DataFrame of ids becomes a left-semi join
    (AQE broadcasts it only when it is measured small)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(key)).distinct(), key, "left_semi")
    ids = list(ids)
    if len(ids) > max_literal:
        return customers_in_list(df, df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} long"), key)
    return df.where(F.col(key).isin(ids))
