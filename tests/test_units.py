"""Hand-written cases (FIXTURES.md part C) and properties."""

import hashlib
import math
import os
import tempfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from propel.functions.core import md5_mod
from propel.functions.prefix import running_sums
from propel.functions.quantile import exact_quantiles
from propel.operators import decisions as dc
from propel.operators import experiments as ex
from propel.operators import features as ft
from propel.operators import validation as vd
from propel.sources import files as fs


def _tmp():
    return tempfile.mkdtemp(prefix="propel-test-")


# ---- block text -----------------------------------------------------------------
def test_block_reader_headers_splits_and_bad_lines(spark):
    d = _tmp()
    f1 = ["5,3,2005-01-01",          # before any header: movie NULL
          "1:", "10,4,2005-09-06", "11,5,2005-09-07", "",
          "2:",                       # empty block
          "3:", "12,3,2004-01-02", "bad line", "13,x,2004-01-03", "14,2,2004-01-04"]
    # a long block so that it spans split boundaries at a tiny maxPartitionBytes
    f1 += ["4:"] + [f"{100 + i},{1 + i % 5},2003-03-{1 + i % 28:02d}" for i in range(400)]
    f2 = ["7:", "20,1,2001-01-01", "21,2", "8:", "22,5,2002-02-02"]
    with open(os.path.join(d, "ratings_part1.txt"), "w") as fh:
        fh.write("\n".join(f1) + "\n")
    with open(os.path.join(d, "ratings_part2.txt"), "w") as fh:
        fh.write("\n".join(f2) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert spark.read.text(d).rdd.getNumPartitions() > 4
        got = fs.read_rating_blocks(spark, d).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = got.sort_values("user_id").reset_index(drop=True)
    by_user = dict(zip(got.user_id, got.movie_id))
    assert pd.isna(by_user[5])
    assert by_user[10] == 1 and by_user[11] == 1
    assert by_user[12] == 3 and by_user[14] == 3 and 13 not in by_user
    assert all(by_user[100 + i] == 4 for i in range(400))
    assert by_user[20] == 7 and by_user[22] == 8 and 21 not in by_user
    assert len(got) == 2 + 2 + 1 + 400 + 2 + 1 - 1 + 1 - 1  # every parsable 3-field line


def test_check_rating_lines_classifies(spark):
    lines = spark.createDataFrame([(x,) for x in ["1:", "10,4,2005-09-06", "10,9,2005-09-06", "a,b",
                                                  "x:", "12,y,2004-01-02", ""]], "value string")
    r = vd.check_rating_lines(lines).first()
    assert (r.headers, r.valid_ratings, r.bad_field_count, r.bad_number, r.rating_out_of_range) == (1, 1, 1, 2, 1)
    assert r.valid is False and r.total_lines == 6


# ---- titles -----------------------------------------------------------------------
def test_titles_latin1_commas_null_year(spark):
    d = _tmp()
    with open(os.path.join(d, "titles.csv"), "wb") as fh:
        fh.write("1,2003,Dinosaur Planet\n2,NULL,Hello, World, Again\n\n3,1999,Caf\xe9 Noir\n".encode("latin-1"))
    got = {r.movie_id: (r.year, r.title) for r in fs.read_titles(spark, d).collect()}
    assert got[1] == (2003, "Dinosaur Planet")
    assert got[2] == (None, "Hello, World, Again")
    assert got[3] == (1999, "Café Noir")
    assert len(got) == 3


def test_reference_patterns_substring_match(spark):
    m = spark.createDataFrame([(1, "Edward Scissorhands"), (2, "Family Story"), (3, None)],
                              "movie_id long, title string")
    r = {x.movie_id: x for x in ft.title_category_flags(m).collect()}
    assert r[1].genre_action == 1        # 'war' inside 'Edward' (kept quirk)
    assert r[2].genre_drama == 1 and r[2].genre_action == 0
    assert r[3].genre_action == 0


# ---- rating statistics edges ---------------------------------------------------------
def _ratings(spark, rows):
    return spark.createDataFrame([(u, m, r, datetime.fromisoformat(d)) for u, m, r, d in rows],
                                 "user_id long, movie_id long, rating int, date timestamp")


def test_distribution_variance_skew_edges(spark):
    rows = [(1, 1, 4, "2005-01-01"),                                            # one rating
            (2, 1, 3, "2005-01-01"), (2, 2, 3, "2005-01-02"), (2, 3, 3, "2005-01-03"),  # all equal
            (3, 1, 1, "2005-01-01"), (3, 2, 5, "2005-01-02"),                    # two ratings
            (4, 1, 1, "2005-01-01"), (4, 2, 2, "2005-01-02"), (4, 3, 5, "2005-01-05"), (4, 4, 5, "2005-01-06")]
    got = {r.user_id: r for r in ft.rating_distribution(_ratings(spark, rows)).collect()}
    pdf = pd.DataFrame(rows, columns=["u", "m", "r", "d"])
    for u, g in pdf.groupby("u"):
        exp_var = 0.0 if pd.isna(g.r.var()) else g.r.var()
        exp_skew = 0.0 if pd.isna(g.r.skew()) else g.r.skew()
        assert math.isclose(got[u].rating_variance, exp_var, abs_tol=1e-9)
        assert math.isclose(got[u].rating_skew, exp_skew, abs_tol=1e-9)
        assert math.isclose(got[u].rating_5star_pct, (g.r == 5).mean() * 100, abs_tol=1e-9)


def test_rating_features_one_user_and_pandas(spark):
    one = ft.rating_features(_ratings(spark, [(1, 1, 4, "2005-01-01"), (1, 2, 2, "2005-02-01")])).first()
    # a single user: max recency is 0, so engagement and propensity are 0 (NaN filled)
    assert one.recency_days == 0 and one.engagement_score == 0 and one.cross_sell_propensity == 0
    assert one.tenure_days == 31 and one.std_rating > 0
    rows = [(1, 1, 4, "2005-01-01 10:00:00"), (1, 2, 5, "2005-03-01 09:00:00"), (2, 1, 3, "2004-06-01"),
            (3, 4, 1, "2005-03-02 08:00:00"), (3, 5, 2, "2004-01-01")]
    got = {r.user_id: r for r in ft.rating_features(_ratings(spark, rows)).collect()}
    pdf = pd.DataFrame(rows, columns=["user_id", "movie_id", "rating", "date"])
    pdf["date"] = pd.to_datetime(pdf.date, format="ISO8601")
    a = pdf.groupby("user_id").agg(n=("movie_id", "count"), mean=("rating", "mean"), std=("rating", "std"),
                                   first=("date", "min"), last=("date", "max"))
    a["std"] = a["std"].fillna(0)
    a["tenure"] = (a["last"] - a["first"]).dt.days
    a["recency"] = (a["last"].max() - a["last"]).dt.days
    ten = a.tenure.clip(lower=1)
    eng = ((a.n / a.n.max()) + (1 - a.recency / a.recency.max()) + a["mean"] / 5 + (ten / ten.max()).clip(0, 1)) / 4 * 100
    prop = eng / 100 * 0.4 + (a.recency <= 180).astype(int) * 0.3 + 1 / (1 + a["std"]) * 0.3
    for u in a.index:
        assert got[u].tenure_days == a.tenure[u] and got[u].recency_days == a.recency[u]
        assert math.isclose(got[u].engagement_score, eng[u], rel_tol=1e-12)
        assert math.isclose(got[u].cross_sell_propensity, prop[u], rel_tol=1e-12)


def test_elapsed_days_is_floor_of_24h(spark):
    from propel.functions.core import elapsed_days
    df = spark.createDataFrame([(datetime(2005, 1, 2, 9), datetime(2005, 1, 1, 10))], "a timestamp, b timestamp")
    assert df.select(elapsed_days("a", "b").alias("d")).first().d == 0     # 23 h, not 1 calendar day


# ---- bins and bands ------------------------------------------------------------------
def test_readiness_segment_edges(spark):
    vals = [0.0, 0.01, 24.99, 25.0, 25.01, 50.0, 50.01, 75.0, 75.01, 100.0, 100.01]
    df = spark.createDataFrame([(v,) for v in vals], "cross_sell_readiness double")
    got = [r.s for r in df.select(ft.readiness_segment().alias("s")).collect()]
    assert got == [None, "Low", "Low", "Low", "Medium", "Medium", "High", "High", "Very High", "Very High", None]


def test_band_and_action_differ_at_edges(spark):
    df = spark.createDataFrame([(0.25,), (0.5,), (0.75,)], "propensity_score double")
    got = df.select(dc.propensity_band().alias("b"), dc.recommended_action().alias("a")).collect()
    assert [g.b for g in got] == ["Medium", "High", "Very High"]
    assert got[2].a == dc.ACTION_TEXT[1] and got[1].a == dc.ACTION_TEXT[2] and got[0].a == dc.ACTION_TEXT[3]


def test_falsy_stored_values(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0, None, None, 0, 0, 0.0, None)],
                               "customer_id long, recency_days long, engagement_score double, "
                               "days_since_service long, products_owned array<string>, had_claim_60d int, "
                               "renewal_in_30_days int, lost_quotation_count long, monetary double, frequency long")
    r = dc.model_input_project(df).first()
    assert r.recency_days == 9999 and r.engagement_score == 0.5 and r.days_since_service == 9999
    assert r.num_products == 1 and r.owns_A == 0 and r.had_claim_60d == 0
    u = df.select(dc.urgency_points("engagement_score").alias("p")).first().p
    assert u == 0          # 0 days since service is falsy and earns nothing


def test_weighted_target_float_edge(spark):
    df = spark.createDataFrame([(0, 0, 1, 600000.0), (1, 0, 1, 0.0), (1, 1, 0, 0.0)],
                               "had_claim_60d int, renewal_in_30_days int, owns_B int, income double")
    got = [r.t for r in df.select(ft.weighted_target_rule().alias("t")).collect()]
    assert got == [0, 1, 1]        # 0.2 + 0.2 is not above 0.4


# ---- hashing, quantiles, prefix sums, AUC ----------------------------------------------
def test_md5_mod_matches_python(spark):
    ids = list(range(-50, 2000, 7))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.b for r in df.select("id", md5_mod(F.col("id"), 100).alias("b")).collect()}
    for i in ids:
        assert got[i] == int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 100


def test_exact_quantiles_match_pandas(spark):
    import random
    rnd = random.Random(7)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) if rnd.random() < 0.5 else rnd.random() * 100 for _ in range(3000)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "x double, g int")
    qs = [0.0, 0.2, 0.5, 0.7, 0.99, 1.0]
    r = exact_quantiles(df, "x", qs).first()
    s = pd.Series(vals)
    for i, q in enumerate(qs):
        assert math.isclose(r[f"q{i}"], s.quantile(q), rel_tol=1e-12)
    by = {x.g: x.q0 for x in exact_quantiles(df, "x", [0.3], group=["g"]).collect()}
    pdf = pd.DataFrame({"x": vals, "g": [i % 3 for i in range(len(vals))]})
    for g, v in pdf.groupby("g").x.quantile(0.3).items():
        assert math.isclose(by[g], v, rel_tol=1e-12)
    assert exact_quantiles(df.where("x < -1"), "x", [0.5]).first().q0 is None


def test_running_sums_equal_global_window(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 50), rnd.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k long, v long")
    got = {r.id: r.cum_v for r in running_sums(df, ["k", "id"], ["v"], buckets=16).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "k", "v"]).sort_values(["k", "id"])
    pdf["c"] = pdf.v.cumsum()
    assert all(got[i] == c for i, c in zip(pdf.id, pdf.c))


def test_auc_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    import random
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "label int, score double")
    ours = ex.auc_roc(df).first().auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(
        df.withColumn("label", F.col("label").cast("double")))
    assert math.isclose(ours, ev, abs_tol=1e-9)


def test_stratified_split_is_exact_per_class(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = ex.train_test_split_strat(df, "k", "y", 0.2)
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = c[(y, "test")] + c[(y, "train")]
        assert abs(c[(y, "test")] - 0.2 * n) <= 1


# ---- empty inputs --------------------------------------------------------------------
@pytest.mark.parametrize("fn", [ft.rating_features, ft.user_rating_agg, ft.rating_distribution,
                                ft.rating_as_rfm, ft.recent_high_rating_target])
def test_empty_rating_inputs(spark, fn):
    assert fn(_ratings(spark, [])).count() == 0


def test_empty_auc_and_validation(spark):
    e = spark.createDataFrame([], "label int, score double")
    assert ex.auc_roc(e).first().auc is None
    v = vd.validate_features(spark.createDataFrame([], "customer_id long, age long"))
    assert v.where("column = 'age'").first().failing_rows == 0


# ---- stateful labels -----------------------------------------------------------------
def test_missing_feature_path_is_empty(spark):
    df = fs.read_parquet_features(spark, "/nonexistent/features.parquet", "user_id long, total_ratings long")
    assert df.count() == 0 and df.columns == ["user_id", "total_ratings"]


def test_in_list_forms_agree(spark):
    c = spark.range(1, 200).select(F.col("id").alias("customer_id"))
    ids = [3, 5, 7, 500]
    a = {r.customer_id for r in dc.customers_in_list(c, ids).collect()}
    b = {r.customer_id for r in dc.customers_in_list(c, spark.createDataFrame([(i,) for i in ids], "customer_id long")).collect()}
    assert a == b == {3, 5, 7}


def test_reasoning_percent_fallback(spark):
    df = spark.createDataFrame([(0, 0, 0.1, 10.0, 0.734)], "renewal_in_30_days int, had_claim_60d int, "
                               "engagement_score double, monetary double, p double")
    r = df.select(dc.reasoning_short(percent_of="p").alias("a"), dc.reasoning_short().alias("b")).first()
    assert r.a == "Propensity: 73%" and r.b == dc.REASONS_SHORT_DEFAULT


def test_check_rating_lines_sample_is_repeatable(spark):
    from propel.session import unique_dir
    t = _ratings(spark, [(u, u % 7, 1 + u % 5, "2005-01-01") for u in range(500)])
    path = fs.write_rating_blocks(t, unique_dir(spark, "lines"), files=2)
    a = vd.check_rating_lines(fs.read_block_lines(spark, path), fraction=0.3).first()
    b = vd.check_rating_lines(fs.read_block_lines(spark, path), fraction=0.3).first()
    full = vd.check_rating_lines(fs.read_block_lines(spark, path)).first()
    assert a == b and 0 < a.total_lines < full.total_lines and full.valid_ratings == 500


def test_size_for_input(spark):
    from propel.session import size_for_input
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = size_for_input(spark, 100 * (1 << 40), cores=8000)
        assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))


def test_yearly_activity_derives_years(spark):
    r = _ratings(spark, [(1, 1, 4, "2004-01-01"), (1, 2, 5, "2005-03-01"), (2, 1, 3, "2005-06-01")])
    got = {x.user_id: x for x in ft.yearly_activity(r).collect()}
    assert got[1].y2004 == 1 and got[1].y2005 == 1 and got[2].y2004 == 0


def test_auc_of_billions_does_not_overflow(spark):
    df = spark.range(4).selectExpr("id % 2 AS label", "id AS score")
    assert ex.auc_roc(df).first().auc == 0.75
    assert spark.sql("SELECT CAST(4000000000 AS DOUBLE) * 6000000000L AS x").first().x == 2.4e19


def test_rating_text_with_bad_date_and_large_id(spark):
    from propel.session import unique_dir
    path = unique_dir(spark, "dirty")
    spark.createDataFrame([("7:",), ("3000000000,5,2005-01-02",), ("4,3,2005-13-99",), ("5,2,",)], "value string").coalesce(1).write.text(path)
    assert [(r.user_id, r.movie_id, r.rating) for r in fs.read_rating_blocks(spark, path).collect()] == [(3000000000, 7, 5)]
    back = unique_dir(spark, "large")
    fs.write_rating_blocks(fs.read_rating_blocks(spark, path), back, files=1)
    assert fs.read_rating_blocks(spark, back).first().user_id == 3000000000


def test_drift_status_uses_raw_mean(spark):
    r = vd.drift_means(spark.createDataFrame([(0.004,)], "a double"), ["a"]).first()
    assert (r.current_mean, r.status) == (0.0, "stable")


def test_shared_folder_is_demanded_on_a_cluster():
    from types import SimpleNamespace

    from propel.session import shared_dir
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        shared_dir(fake)


def test_yearly_keys_take_their_years_from_the_data(spark, tmp_path):
    from conftest import SF_SMALL
    import __spark_entry__ as E
    later = F.col("l_shipdate") + F.expr("INTERVAL 9 YEARS")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    shift = F.when(F.col("l_orderkey") % 2 == 0, later).when(F.col("l_orderkey") % 7 != 0, F.col("l_shipdate"))
    li.withColumn("l_shipdate", shift.cast(li.schema["l_shipdate"].dataType)).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    dated = spark.read.parquet(f"{tmp_path}/lineitem.parquet").where("l_shipdate IS NOT NULL")
    years = sorted(r[0] for r in dated.select(F.year("l_shipdate")).distinct().collect())
    assert years[-1] > 2001
    for key in ("yearly_activity", "activity_trend", "temporal_segments"):
        df = E.queries()[key](spark, str(tmp_path))
        assert [c for c in df.columns if c[0] == "y"] == [f"y{y}" for y in years]
        assert df.agg(F.sum(sum(F.col(f"y{y}") for y in years))).first()[0] == dated.count()


def test_ranges_split_ties_evenly(spark):
    """Nine tenths of the rows share one time: no range above twice the mean, sums exact."""
    from propel.functions.prefix import ranges
    rows = [(i, 5 if i % 10 else i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, k long").withColumn("one", F.lit(1).cast("long")).repartition(6)
    b, n = ranges(df, ["k", "id"], 16)
    sizes = [r["count"] for r in b.groupBy("_bucket").count().collect()]
    assert n == 16 and len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16
    got = {r.id: r.cum_one for r in running_sums(df, ["k", "id"], ["one"], buckets=16).collect()}
    want = {i: at + 1 for at, (_, i) in enumerate(sorted((k, i) for i, k in rows))}
    assert got == want
