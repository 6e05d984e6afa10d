"""Data validation: declared rules checked in one pass.

Each rule is a boolean column; all rules of a table are counted inside a
single aggregate (``count_if(NOT rule)``) and turned into rows with
``stack``, so validation costs one scan however many rules there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# fixed values that must equal the reference: the feature-table schema
# (column, declared type, rule kind, bounds / allowed set)
# ---------------------------------------------------------------------------
FEATURE_SCHEMA = [
    ("customer_id", "int", "ge", 1, None),
    ("recency_days", "int", "range", 0, 2000),
    ("frequency", "int", "ge", 0, None),
    ("monetary", "float", "range", 0.0, 5.0),
    ("tenure_days", "int", "ge", 0, None),
    ("num_products", "int", "range", 1, 50),
    ("engagement_score", "float", "range", 0.0, 1.0),
    ("days_since_service", "int", "ge", 0, None),
    ("had_claim_60d", "int", "isin", (0, 1), None),
    ("renewal_in_30_days", "int", "isin", (0, 1), None),
    ("lost_quotation_count", "int", "ge", 0, None),
    ("owns_A", "int", "isin", (0, 1), None),
    ("owns_B", "int", "isin", (0, 1), None),
    ("owns_C", "int", "isin", (0, 1), None),
    ("age", "int", "range", 18, 75),
    ("income", "float", "ge", 0.0, None),
    ("target", "int", "isin", (0, 1), None),
]
# request rules: allowed actions and outcomes, note length, score and limit ranges
ACTIONS = ["called_interested", "called_not_interested", "email_sent", "ignored"]
OUTCOMES = ["converted", "not_converted", "pending"]
NOTES_MAX = 500
LIMIT_RANGE = (1, 50)
TITLE_YEAR_RANGE = (1000, 2006)
RATING_VALUES = (1, 2, 3, 4, 5)

def rule_text(kind, a, b) -> str:
    if kind == "ge":
        return f"greater_than_or_equal_to({a})"
    if kind == "range":
        return f"in_range({a}, {b})"
    return f"isin({list(a)})"


def coerced(c: str, typ: str) -> Column:
    """Coercion first (``try_cast``): a value that does not coerce fails its rule.
    Floats coerce to int only when integral, as pandas does."""
    if typ == "int":
        d = F.col(c).cast("string").try_cast("double")
        return F.when(d == F.floor(d), d.cast("bigint"))
    return F.col(c).cast("string").try_cast("double")


def rule_ok(c: str, typ: str, kind, a, b) -> Column:
    v = coerced(c, typ)
    if kind == "ge":
        ok = v >= a
    elif kind == "range":
        ok = v.between(a, b)
    else:
        ok = v.isin(*a)
    return F.coalesce(ok, F.lit(False))  # NULL (missing or not coercible) fails


def validate_features(df: DataFrame, schema=FEATURE_SCHEMA) -> DataFrame:
    """Rows (column, check, failing_rows, passed) plus a table verdict column."""
    present = [s for s in schema if s[0] in df.columns]
    missing = [s for s in schema if s[0] not in df.columns]
    aggs = [F.count_if(~rule_ok(c, t, k, a, b)).alias(f"f{i}") for i, (c, t, k, a, b) in enumerate(present)]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    one = df.agg(*aggs)
    entries = []
    for i, (c, t, k, a, b) in enumerate(present):
        entries.append(F.struct(F.lit(c).alias("column"), F.lit(rule_text(k, a, b)).alias("check"),
                                F.col(f"f{i}").alias("failing_rows")))
    for c, t, k, a, b in missing:
        entries.append(F.struct(F.lit(c).alias("column"), F.lit("column_present").alias("check"),
                                F.col("_rows").alias("failing_rows")))
    rows = one.select(F.inline(F.array(*entries)))
    verdict = rows.agg(F.coalesce(F.bool_and(F.col("failing_rows") == 0), F.lit(True)).alias("table_valid"))
    return (rows.withColumn("passed", F.col("failing_rows") == 0)
            .crossJoin(F.broadcast(verdict)))


def validation_failures(df: DataFrame, key: str = "customer_id", schema=FEATURE_SCHEMA) -> DataFrame:
    """The failing cells: key, column, value (text), check."""
    present = [s for s in schema if s[0] in df.columns]
    def text(c, t):
        return (F.col(c).cast("string") if t == "int"
                else F.format_string("%.6f", F.col(c).cast("double")))
    cells = [F.when(~rule_ok(c, t, k, a, b),
                    F.struct(F.lit(c).alias("column"), text(c, t).alias("value"),
                             F.lit(rule_text(k, a, b)).alias("check")))
             for c, t, k, a, b in present]
    arr = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return df.select(F.col(key), F.inline(arr))


def classify_rating_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Label every raw line: blank, header, bad_header, ok, bad_fields, bad_number, bad_rating."""
    s = F.trim(F.col(text_col))
    parts = F.split(s, ",", -1)
    user = F.try_element_at(parts, F.lit(1)).try_cast("int")
    rating = F.try_element_at(parts, F.lit(2)).try_cast("int")
    kind = (F.when(s == "", "blank")
            .when(s.endswith(":"), F.when(F.regexp_extract(s, r"^(.*):$", 1).try_cast("int").isNotNull(), "header")
                  .otherwise("bad_header"))
            .when(F.size(parts) != 3, "bad_fields")
            .when(user.isNull() | rating.isNull(), "bad_number")
            .when(~rating.isin(*RATING_VALUES), "bad_rating")
            .otherwise("ok"))
    return lines.select("*", kind.alias("line_kind"), rating.alias("rating"),
                        F.when(kind == "header", F.regexp_extract(s, r"^(.*):$", 1).try_cast("int"))
                        .alias("header_movie_id"))


def check_rating_lines(lines: DataFrame, text_col: str = "value", fraction: float | None = None) -> DataFrame:
    """Counts per line kind, rating range, distinct movies and the valid flag.

    All lines by default; with ``fraction`` a repeatable sample (hash of the
    file, split and line text), the same lines on every run.
    """
    if fraction is not None:
        h = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col(text_col)) \
            if "_metadata" not in lines.columns and _has_metadata(lines) else F.xxhash64(F.col(text_col))
        lines = lines.where(F.pmod(h, F.lit(10000)) < int(round(fraction * 10000)))
    c = classify_rating_lines(lines, text_col)
    k = F.col("line_kind")
    g = c.agg(
        F.count_if(k != "blank").alias("total_lines"),
        F.count_if(k == "header").alias("headers"),
        F.count_if(k == "ok").alias("valid_ratings"),
        F.count_if(k == "bad_fields").alias("bad_field_count"),
        F.count_if((k == "bad_number") | (k == "bad_header")).alias("bad_number"),
        F.count_if(k == "bad_rating").alias("rating_out_of_range"),
        F.min(F.when(k == "ok", F.col("rating"))).alias("min_rating"),
        F.max(F.when(k == "ok", F.col("rating"))).alias("max_rating"),
        F.countDistinct("header_movie_id").alias("movie_ids_found"))
    issues = F.col("bad_field_count") + F.col("bad_number") + F.col("rating_out_of_range")
    return g.withColumn("valid", (F.col("valid_ratings") > 0) & (issues == 0))


def _has_metadata(df: DataFrame) -> bool:
    try:
        df.select(F.col("_metadata.file_path")).schema
        return True
    except Exception:
        return False


def check_titles(titles: DataFrame, lo: int = TITLE_YEAR_RANGE[0], hi: int = TITLE_YEAR_RANGE[1]) -> DataFrame:
    y = F.col("year")
    bad_year = (y < lo) | (y > hi)
    g = titles.agg(F.count(F.lit(1)).alias("total_movies"),
                   F.count_if(F.col("movie_id").cast("string").try_cast("bigint").isNull()).alias("non_numeric_ids"),
                   F.countDistinct(F.when(bad_year, y)).alias("invalid_year_anomalies"))
    return g.withColumn("valid", (F.col("non_numeric_ids") == 0) & (F.col("invalid_year_anomalies") == 0))


def validation_report(checks: dict[str, DataFrame]) -> DataFrame:
    """One verdict row per check (each input has a boolean ``valid``) plus ``overall``."""
    parts = [df.select(F.lit(n).alias("check"), F.col("valid")) for n, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    overall = out.agg(F.bool_and("valid").alias("valid")).select(F.lit("overall").alias("check"), "valid")
    return out.unionByName(overall)


def request_rule_check(feedback: DataFrame, queue: DataFrame | None = None, score: str = "propensity_score",
                       limit_col: str | None = None) -> DataFrame:
    """Violations per request rule: action set, outcome set, notes <= 500, score in 0..1, limit 1..50."""
    acts = "^(" + "|".join(ACTIONS) + ")$"
    outs = "^(" + "|".join(OUTCOMES) + ")$"
    aggs = [F.count(F.lit(1)).alias("feedback_rows"),
            F.count_if(~F.coalesce(F.col("action_taken").rlike(acts), F.lit(False))).alias("bad_action"),
            F.count_if(F.col("outcome").isNotNull() & ~F.col("outcome").rlike(outs)).alias("bad_outcome")]
    if "notes" in feedback.columns:
        aggs.append(F.count_if(F.length("notes") > NOTES_MAX).alias("notes_too_long"))
    else:
        aggs.append(F.lit(0).cast("long").alias("notes_too_long"))
    out = feedback.agg(*aggs)
    if queue is not None:
        qa = [F.count_if(~F.coalesce(F.col(score).between(0, 1), F.lit(False))).alias("bad_score")]
        if limit_col:
            qa.append(F.count_if(~F.col(limit_col).between(*LIMIT_RANGE)).alias("bad_limit"))
        out = out.crossJoin(queue.agg(*qa))
    return out


def drift_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column, status stable when mean > 0 else warning."""
    one = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)])
    # the status looks at the raw mean; rounding is for display
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(f"m{i}"), 2).alias("current_mean"),
                             F.when(F.col(f"m{i}") > 0, "stable").otherwise("warning").alias("status"))
                    for i, c in enumerate(cols)])
    return one.select(F.inline(arr))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, x) of the non-null values of all columns."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(F.inline(arr)).where(F.col("x").isNotNull())


def _psi(pc, pb, eps: float):
    c, b = F.greatest(F.coalesce(pc, F.lit(0.0)), F.lit(eps)), F.greatest(F.coalesce(pb, F.lit(0.0)), F.lit(eps))
    return (c - b) * F.log(c / b)


def drift_vs_baseline(baseline: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = 10,
                      eps: float = 1e-6) -> DataFrame:
    """Mean shift in baseline standard deviations and PSI over baseline decile bins. All columns
    go through each pass together."""
    from propel.functions.quantile import exact_quantiles
    from propel.session import materialize
    b, c = materialize(_long(baseline, cols)), materialize(_long(current, cols))
    qs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(b, "x", qs, group=["feature"]).select("feature", F.array(*[F.col(f"q{i}") for i in range(len(qs))]).alias("_e"))

    def shares(df, name):
        x = df.join(F.broadcast(edges), "feature")                              # a row per column
        n = x.groupBy("feature", F.size(F.filter("_e", lambda e: F.col("x") > e)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        tot = n.groupBy("feature").agg(F.sum("_n").alias("_t"))
        return n.join(F.broadcast(tot), "feature").select("feature", "_bin", (F.col("_n") / F.col("_t")).alias(name))
    names = baseline.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "_i int, feature string")
    spine = names.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    psi = (spine.join(shares(b, "pb"), ["feature", "_bin"], "left").join(shares(c, "pc"), ["feature", "_bin"], "left")
           .groupBy("feature").agg(F.sum(_psi(F.col("pc"), F.col("pb"), eps)).alias("psi")))
    bs = b.groupBy("feature").agg(F.avg("x").alias("baseline_mean"), F.stddev_samp("x").alias("baseline_std"))
    cs = c.groupBy("feature").agg(F.avg("x").alias("current_mean"))
    return (names.join(bs, "feature", "left").join(cs, "feature", "left").join(psi, "feature", "left")
            .select("feature", "baseline_mean", "baseline_std", "current_mean",
                    F.try_divide(F.col("current_mean") - F.col("baseline_mean"), F.col("baseline_std")).alias("mean_shift_std"), "psi"))


#: KLL sketch size, and the rank error that it keeps with 99% confidence
SKETCH_K, SKETCH_RANK_ERROR = 1000, 0.004


def drift_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One small row per column, to be stored with the model: n, mean, m2 (squared deviations)
    and a quantile sketch. Profiles of parts merge (:func:`merge_profiles`)."""
    g = _long(df, cols).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("_v"),
                                               F.kll_sketch_agg_double("x", SKETCH_K).alias("sketch"))
    return g.select("feature", "n", "mean", (F.col("_v") * F.col("n")).alias("m2"), "sketch")


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One profile from the profiles of parts, in any order."""
    all_ = profiles.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"))
    j = profiles.join(F.broadcast(all_), "feature")                              # a row per column
    return j.groupBy("feature").agg(F.sum("n").alias("n"), F.first("_m").alias("mean"),
                                    F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_m"), F.lit(2))).alias("m2"),
                                    F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def drift_from_profiles(baseline: DataFrame, current: DataFrame, bins: int = 10, points: int = 100, grid: int = 1000, eps: float = 1e-6) -> DataFrame:
    """Drift from two profiles alone: mean shift, PSI over the baseline's bins, and the largest
    difference of the two distribution functions with its error bound. No data row is read;
    ranks come from ``grid`` quantiles of each sketch."""
    ranks = F.array(*[F.lit(i / grid) for i in range(1, grid + 1)])
    grids = lambda s: F.kll_sketch_get_quantile_double(s, ranks)
    b = baseline.select("feature", F.col("n").alias("bn"), F.col("mean").alias("baseline_mean"), F.col("m2").alias("bm2"), grids("sketch").alias("bg"))
    c = current.select("feature", F.col("mean").alias("current_mean"), grids("sketch").alias("cg"))
    j = b.join(c, "feature")
    some = lambda g, n: F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get(F.col(g), (i * grid / n).cast("int") - 1))
    share = lambda g, x: F.size(F.filter(g, lambda v: v <= x)) / float(grid)
    j = j.withColumn("_e", some("bg", bins)).withColumn("_at", F.array_distinct(F.concat(some("bg", points), some("cg", points))))
    j = j.withColumns({"_rb": F.transform("_e", lambda x: share("bg", x)), "_rc": F.transform("_e", lambda x: share("cg", x))})
    ends = lambda r: F.concat(F.array(F.lit(0.0)), F.col(r), F.array(F.lit(1.0)))
    j = j.withColumns({"_rb": ends("_rb"), "_rc": ends("_rc")})
    i = F.sequence(F.lit(1), F.lit(bins))
    step = lambda r, k: F.get(F.col(r), k) - F.get(F.col(r), k - 1)
    psi = F.aggregate(F.transform(i, lambda k: _psi(step("_rc", k), step("_rb", k), eps)), F.lit(0.0), lambda a, x: a + x)
    ks = F.array_max(F.transform("_at", lambda x: F.abs(share("bg", x) - share("cg", x))))
    std = F.sqrt(F.try_divide(F.col("bm2"), F.col("bn") - 1))
    return j.select("feature", "baseline_mean", std.alias("baseline_std"), "current_mean",
                    F.try_divide(F.col("current_mean") - F.col("baseline_mean"), std).alias("mean_shift_std"), psi.alias("psi"),
                    ks.alias("ks"), F.lit(2 * (SKETCH_RANK_ERROR + 1.0 / grid) + 1.0 / points).alias("ks_error"))


def sample_fraction(df: DataFrame, key: str, fraction: float = 0.1) -> DataFrame:
    """Repeatable sample: md5 bucket of the key below fraction x 100 (stable under repartition)."""
    from propel.functions.core import md5_mod
    return df.where(md5_mod(F.col(key), 100) < int(round(fraction * 100)))


