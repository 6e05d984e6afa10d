"""Keyed queries: sources and sinks (2.1) as write-then-read round trips.

Every round trip writes into a fresh folder under the session's shared
checkpoint dir (``spark.checkpoint.dir``) and returns the lazy read-back,
whose rows must equal the oracle computed from the base tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from propel.operators import experiments as ex
from propel.operators import features as ft
from propel.operators import validation as vd
from propel.plans.q_features import AS_OF, RATING_FEATURES_SQL, RFM_MATRIX_STAGED_SQL, RFM_SQL
from propel.plans.q_reports import _auc_sql, _validate_sql, feature_matrix
from propel.plans.registry import DAYS, R, TS, query
from propel.session import unique_dir
from propel.sources import files as fs
from propel.sources import store as st

RATINGS_OUT = f"SELECT user_id, movie_id, rating, {TS('date', 'date')} FROM ratings"


@query("src_rating_blocks", RATINGS_OUT)
def q_src_rating_blocks(t):
    # salted blocks: a movie may be split over several files (repeated headers)
    path = fs.write_rating_blocks(t.ratings(), unique_dir(t.spark, "blocks"), files=4, salts=4)
    return fs.read_rating_blocks(t.spark, path)


CHECK_LINES_SQL = """
SELECT count(*) + count(DISTINCT movie_id) AS total_lines, count(DISTINCT movie_id) AS headers,
  count(*) AS valid_ratings, CAST(0 AS BIGINT) AS bad_field_count, CAST(0 AS BIGINT) AS bad_number,
  CAST(0 AS BIGINT) AS rating_out_of_range, min(rating) AS min_rating, max(rating) AS max_rating,
  count(DISTINCT movie_id) AS movie_ids_found, count(*) > 0 AS valid
FROM ratings"""


@query("check_rating_lines", CHECK_LINES_SQL)
def q_check_rating_lines(t):
    path = fs.write_rating_blocks(t.ratings(), unique_dir(t.spark, "blocks"), files=4)
    return vd.check_rating_lines(fs.read_block_lines(t.spark, path))


TITLES_CHECK_SQL = """SELECT count_if(TRY_CAST(CAST(movie_id AS VARCHAR) AS BIGINT) IS NULL) = 0
    AND count(DISTINCT CASE WHEN year < 1000 OR year > 2006 THEN year END) = 0 AS valid FROM movies"""


@query("validation_report", f"""
SELECT 'titles' AS "check", valid FROM ({TITLES_CHECK_SQL})
UNION ALL SELECT 'rating_lines', valid FROM ({CHECK_LINES_SQL})
UNION ALL SELECT 'features', bool_and(passed) FROM ({_validate_sql()})
UNION ALL SELECT 'overall', bool_and(v) FROM (
  SELECT valid AS v FROM ({TITLES_CHECK_SQL}) UNION ALL SELECT valid FROM ({CHECK_LINES_SQL})
  UNION ALL SELECT bool_and(passed) FROM ({_validate_sql()}))""")
def q_validation_report(t):
    path = fs.write_rating_blocks(t.ratings(), unique_dir(t.spark, "blocks"), files=4)
    feats = vd.validate_features(feature_matrix(t)).agg(F.bool_and("passed").alias("valid"))
    return vd.validation_report({"titles": vd.check_titles(t.movies()),
                                 "rating_lines": vd.check_rating_lines(fs.read_block_lines(t.spark, path)),
                                 "features": feats})


@query("src_titles_delimited", "SELECT movie_id, year, title FROM movies")
def q_src_titles_delimited(t):
    path = fs.write_titles(t.movies(), unique_dir(t.spark, "titles"))
    return fs.read_titles(t.spark, path)


TX_SCHEMA = "customer_id bigint, transaction_date timestamp, amount double"


@query("src_csv_typed", f"SELECT customer_id, {TS('transaction_date', 'transaction_date')}, {R('amount', 'amount')} FROM transactions")
def q_src_csv_typed(t):
    path = fs.write_csv(t.transactions(), unique_dir(t.spark, "csv"))
    return fs.read_csv_typed(t.spark, path, TX_SCHEMA)


RATING_FEATURE_SCHEMA = ("user_id bigint, total_ratings bigint, unique_movies bigint, mean_rating double, "
                         "std_rating double, min_rating int, max_rating int, tenure_days bigint, recency_days bigint, "
                         "rating_velocity double, is_active_6m int, is_active_1y int, rating_consistency double, "
                         "engagement_score double, cross_sell_propensity double")


@query("src_parquet_features", RATING_FEATURES_SQL)
def q_src_parquet_features(t):
    path = fs.write_parquet(ft.rating_features(t.ratings()), unique_dir(t.spark, "features"))
    return fs.read_parquet_features(t.spark, path, RATING_FEATURE_SCHEMA)


@query("src_feature_table", RFM_MATRIX_STAGED_SQL)
def q_src_feature_table(t):
    path = fs.write_parquet(feature_matrix(t), unique_dir(t.spark, "feature_table"))
    t.spark.read.parquet(path).createOrReplaceTempView("features")
    return t.spark.sql("SELECT * FROM features")


@query("json_column_parse", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') AS k_text,
       CAST(to_json(struct_pack(k := CAST(json_extract(props, '$.k') AS INT))) AS VARCHAR) AS props_json FROM events""")
def q_json_column_parse(t):
    e = fs.parse_json_column(t.base("events").select("event_id", "props"), "props", "struct<k:int>")
    return e.select("event_id", F.col("props_parsed.k").alias("k"), F.get_json_object("props", "$.k").alias("k_text"),
                    F.to_json("props_parsed").alias("props_json"))


@query("sink_parquet_features", RFM_MATRIX_STAGED_SQL)
def q_sink_parquet_features(t):
    path = fs.write_parquet(feature_matrix(t), unique_dir(t.spark, "sink_features"))
    return t.spark.read.parquet(path)


@query("sink_csv_export", f"""
WITH fm AS ({RFM_MATRIX_STAGED_SQL})
SELECT c.customer_id, c.name, c.region, c.age, {R('c.income', 'income')}, c.products_owned_str,
       f.recency_days, f.frequency, {R('f.monetary', 'monetary')}
FROM customers c JOIN fm f ON c.customer_id = f.customer_id""")
def q_sink_csv_export(t):
    base = unique_dir(t.spark, "csv_export")
    cust = t.customers().select("customer_id", "name", "region", "age", "income", "products_owned_str")
    feat = feature_matrix(t).select("customer_id", "recency_days", "frequency", "monetary")
    fs.write_csv(cust, base + "/customers")
    fs.write_csv(feat, base + "/features")
    c = fs.read_csv_typed(t.spark, base + "/customers",
                          "customer_id bigint, name string, region string, age bigint, income double, "
                          "products_owned_str string")
    f = fs.read_csv_typed(t.spark, base + "/features",
                          "customer_id bigint, recency_days bigint, frequency bigint, monetary double")
    return c.join(f, "customer_id")


@query("sink_table_replace", RFM_SQL)
def q_sink_table_replace(t):
    path = unique_dir(t.spark, "table_replace")
    older = t.transactions().where(F.col("transaction_date") < F.lit("2000-12-01").cast("timestamp_ntz"))
    fs.write_parquet(ft.rfm_agg(older, "2000-12-01 00:00:00"), path)
    fs.write_parquet(ft.rfm_agg(t.transactions(), AS_OF), path)  # replaces the whole table
    return t.spark.read.parquet(path)


@query("sink_log_append", f"""
SELECT id, customer_id, {R('propensity_score', 'propensity_score')}, model_version, {TS('created_at', 'created_at')},
       true AS has_server_time FROM predictions""")
def q_sink_log_append(t):
    path = unique_dir(t.spark, "prediction_log")
    p = t.predictions()
    fs.append_with_server_time(p.where(F.col("model_version") == "v1"), path)
    fs.append_with_server_time(p.where(F.col("model_version") == "v2"), path)
    r = t.spark.read.parquet(path)
    return r.select("id", "customer_id", "propensity_score", "model_version", "created_at",
                    F.col("logged_at").isNotNull().alias("has_server_time"))


def _store_sql(versions):
    parts = []
    for v, as_of in versions:
        cut = f"WHERE transaction_date < TIMESTAMP '{as_of}'"
        parts.append(f"""SELECT '{v}' AS version, customer_id, count(transaction_date) AS frequency,
  {R('sum(amount)', 'monetary')}, {DAYS(f"TIMESTAMP '{as_of}'", 'max(transaction_date)')} AS recency_days
FROM transactions {cut} GROUP BY customer_id""")
    return "\nUNION ALL\n".join(parts)


STORE_VERSIONS = [("v9", "2000-12-01 00:00:00"), ("v10", "2001-12-01 00:00:00")]


def _write_store(t, path):
    for v, as_of in STORE_VERSIONS:
        tx = t.transactions().where(F.col("transaction_date") < F.lit(as_of).cast("timestamp_ntz"))
        feats = ft.rfm_agg(tx, as_of).select("customer_id", "frequency", "monetary", "recency_days")
        st.feature_store_write(feats, path, v, updated_at=as_of)
    return path


@query("feature_store_write", _store_sql(STORE_VERSIONS))
def q_feature_store_write(t):
    path = _write_store(t, unique_dir(t.spark, "store"))
    s = t.spark.read.parquet(path)
    return s.select("version", "customer_id", "frequency", "monetary", "recency_days")


@query("feature_store_read", f"""
SELECT version, customer_id, frequency, monetary, recency_days FROM ({_store_sql(STORE_VERSIONS)})
WHERE version = 'v10' AND customer_id IN (SELECT customer_id FROM assignments)""")
def q_feature_store_read(t):
    path = _write_store(t, unique_dir(t.spark, "store"))
    r = st.feature_store_read(t.spark, path, ids=t.assignments(), version="latest")
    return r.select("version", "customer_id", "frequency", "monetary", "recency_days")


@query("feature_snapshot_restore", f"""
SELECT version, customer_id, frequency, monetary, recency_days FROM ({_store_sql(STORE_VERSIONS)})""")
def q_feature_snapshot_restore(t):
    store = unique_dir(t.spark, "store")
    snaps = unique_dir(t.spark, "snapshots")
    v, as_of = STORE_VERSIONS[0]
    tx = t.transactions().where(F.col("transaction_date") < F.lit(as_of).cast("timestamp_ntz"))
    st.feature_store_write(ft.rfm_agg(tx, as_of).select("customer_id", "frequency", "monetary", "recency_days"),
                           store, v, updated_at=as_of)
    st.snapshot_store(t.spark, store, snaps, "20240101T000000")
    _write_store(t, store)
    st.snapshot_store(t.spark, store, snaps, "20240102T000000")
    r = st.restore_snapshot(t.spark, snaps)
    return r.select("version", "customer_id", "frequency", "monetary", "recency_days")


RUN_CAPS = {"cap_500": 500.0, "cap_2000": 2000.0, "cap_20000": 20000.0}


def _run_scores(t):
    d = t.base("documents").select("doc_id", "n_chars")
    lab = t.base("labels").select("doc_id", "quality")
    return d.join(lab, "doc_id")


@query("run_log_select_best", "WITH runs AS (" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS run_id, auc FROM ({_auc_sql(f'least(n_chars / {cap}, 1.0)', '(SELECT d.n_chars, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)')})"
    for name, cap in RUN_CAPS.items()) + ") SELECT run_id, auc FROM runs ORDER BY auc DESC NULLS LAST, run_id LIMIT 1")
def q_run_log_select_best(t):
    j = _run_scores(t)
    metrics = None
    for name, cap in RUN_CAPS.items():
        s = j.select(F.col("quality").alias("label"), F.least(F.col("n_chars") / F.lit(cap), F.lit(1.0)).alias("score"))
        m = ex.auc_roc(s).select(F.lit(name).alias("run_id"), F.round("auc", 6).alias("auc"))
        metrics = m if metrics is None else metrics.unionByName(m)
    path = unique_dir(t.spark, "runs")
    st.runs_from_metrics(metrics).write.mode("append").parquet(path)
    return st.run_log_select_best(t.spark.read.parquet(path)).select("run_id", "auc")


@query("run_log_append")
def q_run_log_append(t):
    path = unique_dir(t.spark, "runs")
    s = _run_scores(t).select(F.col("quality").alias("label"),
                              F.least(F.col("n_chars") / F.lit(2000.0), F.lit(1.0)).alias("score"))
    auc = ex.auc_roc(s).first()["auc"]  # one scalar per training run
    st.run_log_append(t.spark, path, "run-1", {"n_estimators": 200, "max_depth": 5, "learning_rate": 0.05},
                      ["n_chars"], {"auc": auc or 0.0})
    return t.spark.read.parquet(path).select("run_id", "auc", F.size("features").alias("n_features"))
