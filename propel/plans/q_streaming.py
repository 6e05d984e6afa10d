"""Keyed queries: service metrics and alerts over request rows (2.14).

The windowed keys run the batch form on ``request_log``; ``*_stream`` keys
run the same function on a file stream (availableNow) and are checked on the
windows the watermark has closed. Fixture scale: 6 h windows sliding 1 h
(about 14 requests per hour at sf0.01), a limiter of 2 per 24 h and a cache
life of 6 h; library defaults stay at the reference values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from propel.streaming import metrics as mt
from propel.streaming import runner as rn
from propel.streaming import stateful as sf
from propel.plans.registry import AS_OF_EVENTS, R, TS, query
from propel.session import unique_dir

SIZE, SLIDE = "6 hours", "1 hour"
SIZE_S, SLIDE_S = 6 * 3600, 3600
BATCH_PATTERN = "^purchase$"
ENDPOINT_PATTERN = "^(purchase|click)$"


def windowed_sql(src: str, size_s: int, slide_s: int) -> str:
    """Rows of ``src`` repeated once per sliding window that contains them
    (epoch-aligned starts, like Spark's ``window``)."""
    su, du = size_s * 1_000_000, slide_s * 1_000_000
    return f"""(SELECT *, make_timestamp(k * {du}) AS window_start, make_timestamp(k * {du} + {su}) AS window_end
 FROM (SELECT *, unnest(range(CAST(floor((epoch_us(CAST(ts AS TIMESTAMP)) - {su}) / {du}) + 1 AS BIGINT),
                             CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / {du}) + 1 AS BIGINT))) AS k FROM {src}))"""


W = windowed_sql("request_log", SIZE_S, SLIDE_S)
WSEL = f"{TS('window_start', 'window_start')}, {TS('window_end', 'window_end')}"


def rl(t):
    return mt.with_event_time(t.request_log())


@query("request_rate", f"""
SELECT {WSEL}, count(*) AS requests, {R(f'count(*) / {float(SIZE_S)}', 'rate_per_s')}
FROM {W} GROUP BY window_start, window_end""")
def q_request_rate(t):
    return mt.request_rate(rl(t), SIZE, SLIDE)


@query("status_class_rate", f"""
SELECT {WSEL}, CAST(CAST(trunc(status / 100) AS INT) AS VARCHAR) || 'xx' AS status_class, count(*) AS requests,
  {R(f'count(*) / {float(SIZE_S)}', 'rate_per_s')}
FROM {W} GROUP BY window_start, window_end, 3""")
def q_status_class_rate(t):
    return mt.status_class_rate(rl(t), SIZE, SLIDE)


@query("endpoint_rate", f"""
SELECT {WSEL}, endpoint, count(*) AS requests, {R(f'count(*) / {float(SIZE_S)}', 'rate_per_s')}
FROM {windowed_sql(f"(SELECT * FROM request_log WHERE regexp_matches(endpoint, '{ENDPOINT_PATTERN}'))", SIZE_S, SLIDE_S)}
GROUP BY window_start, window_end, endpoint""")
def q_endpoint_rate(t):
    return mt.endpoint_rate(rl(t), ENDPOINT_PATTERN, SIZE, SLIDE)


LEVEL_SQL = (f"CASE WHEN avg(duration_seconds) > {mt.LATENCY_CRIT} THEN 'critical' "
             f"WHEN avg(duration_seconds) > {mt.LATENCY_WARN} THEN 'warning' ELSE 'ok' END")


@query("mean_latency", f"""
SELECT {WSEL}, {R('avg(duration_seconds)', 'mean_latency')}, count(*) AS requests, {LEVEL_SQL} AS level
FROM {W} GROUP BY window_start, window_end""")
def q_mean_latency(t):
    return mt.mean_latency(rl(t), SIZE, SLIDE)


@query("error_ratio", f"""
SELECT {WSEL}, count(*) AS requests, count_if(status >= 500) AS errors,
  {R('count_if(status >= 500) / count(*)', 'error_ratio')}, {R(f'count_if(status >= 500) / {float(SIZE_S)}', 'error_rate_per_s')},
  count_if(status >= 500) / count(*) > {mt.SLA_ERROR_RATIO} AS sla_breach
FROM {W} GROUP BY window_start, window_end""")
def q_error_ratio(t):
    return mt.error_ratio(rl(t), SIZE, SLIDE)


def _hist_sql(src="request_log"):
    bounds = mt.LATENCY_BUCKETS + [float("inf")]
    vals = ", ".join(f"({i}, {b if b != float('inf') else "'inf'::DOUBLE"})" for i, b in enumerate(bounds))
    return f"""
SELECT r.endpoint, b.le, count_if(r.duration_seconds <= b.le) AS cumulative_count
FROM {src} r, (SELECT * FROM (VALUES {vals}) t(i, le)) b GROUP BY r.endpoint, b.le"""


@query("latency_histogram", _hist_sql())
def q_latency_histogram(t):
    return mt.latency_histogram(rl(t))


def _quantile_sql(qs=(0.5, 0.95, 0.99)):
    parts = []
    for q in qs:
        name = f"p{int(round(q * 100))}"
        parts.append(f"""{name}t AS (
  SELECT endpoint, arg_min(CASE WHEN le = 'inf'::DOUBLE THEN prev_le
         ELSE prev_le + (le - prev_le) * (total * CAST({q} AS DOUBLE) - prev_c) / (cumulative_count - prev_c) END, le) AS {name}
  FROM h2 WHERE cumulative_count >= total * CAST({q} AS DOUBLE) AND total > 0 GROUP BY endpoint)""")
    sel = ", ".join(R(f"p{int(round(q * 100))}", f"p{int(round(q * 100))}") for q in qs)
    joins = " ".join(f"JOIN p{int(round(q * 100))}t USING (endpoint)" for q in qs[1:])
    return f"""
WITH h AS ({_hist_sql()}),
h2 AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY endpoint ORDER BY le), 0) AS prev_le,
              coalesce(lag(cumulative_count) OVER (PARTITION BY endpoint ORDER BY le), 0) AS prev_c,
              max(cumulative_count) OVER (PARTITION BY endpoint) AS total FROM h),
{', '.join(parts)}
SELECT endpoint, {sel} FROM p{int(round(qs[0] * 100))}t {joins}"""


@query("latency_quantile", _quantile_sql())
def q_latency_quantile(t):
    return mt.latency_quantiles(rl(t))


SKETCH_ERROR = 0.01
_G = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
_SKETCH_QS = (0.5, 0.95, 0.99)


@query("latency_quantile_sketch", f"""
WITH s AS (SELECT endpoint, CASE WHEN duration_seconds > 0 THEN CAST(ceil(ln(CAST(duration_seconds AS DOUBLE)) / ln(CAST({_G!r} AS DOUBLE))) AS BIGINT) END AS bucket,
                  count(*) AS n FROM request_log WHERE duration_seconds IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY endpoint ORDER BY bucket NULLS FIRST) AS cum, sum(n) OVER (PARTITION BY endpoint) AS total,
             coalesce(2 * power(CAST({_G!r} AS DOUBLE), bucket) / ({_G!r} + 1), 0) AS mid FROM s)
SELECT endpoint, CAST(max(total) AS BIGINT) AS requests,
  {', '.join(R(f"min(CASE WHEN cum >= greatest(ceil(total * CAST({q} AS DOUBLE)), 1) THEN mid END)", f"p{int(round(q * 100))}") for q in _SKETCH_QS)}
FROM c GROUP BY endpoint""")
def q_latency_quantile_sketch(t):
    """Sketches of six-hour windows, merged per endpoint."""
    sketch = mt.latency_sketch(rl(t), SIZE, error=SKETCH_ERROR)
    return mt.sketch_quantiles(mt.merge_sketches(sketch), _SKETCH_QS, error=SKETCH_ERROR)


@query("cache_miss_ratio", f"""
SELECT {WSEL}, count_if(cache_hit) AS hits, count_if(NOT cache_hit) AS misses,
  {R('count_if(NOT cache_hit) / count(*)', 'miss_ratio')}, count_if(NOT cache_hit) / count(*) > {mt.CACHE_MISS_ALERT} AS alert
FROM {windowed_sql('request_log', SIZE_S, SIZE_S)} GROUP BY window_start, window_end""")
def q_cache_miss_ratio(t):
    return mt.cache_miss_ratio(rl(t), SIZE)


@query("batch_latency", f"""
SELECT {WSEL}, {R('avg(duration_seconds)', 'mean_batch_latency')}, count(*) AS requests,
  avg(duration_seconds) > {mt.BATCH_LATENCY_ALERT} AS alert
FROM {windowed_sql(f"(SELECT * FROM request_log WHERE regexp_matches(endpoint, '{BATCH_PATTERN}'))", SIZE_S, SIZE_S)}
GROUP BY window_start, window_end""")
def q_batch_latency(t):
    return mt.batch_latency(rl(t), BATCH_PATTERN, SIZE)


@query("availability_ratio", f"""
WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS ts, count_if(status < 500) = 0 AS down
           FROM request_log GROUP BY 1)
SELECT {WSEL}, count(*) AS samples, count_if(down) AS down_samples, {R('count_if(down) / count(*)', 'down_ratio')},
  count_if(down) / count(*) > {mt.AVAILABILITY_ALERT} AS alert
FROM {windowed_sql('s', 86400, 86400)} GROUP BY window_start, window_end""")
def q_availability_ratio(t):
    return mt.availability_ratio(rl(t), sample="1 hour", size="1 day")


SUSTAIN_S = 3 * 3600


def _evals(t):
    lat = mt.mean_latency(rl(t), SIZE, SLIDE).select(
        F.lit("HighAPIResponseTime").alias("rule"), "window_end", (F.col("mean_latency") > mt.LATENCY_WARN).alias("condition"))
    err = mt.error_ratio(rl(t), SIZE, SLIDE).select(
        F.lit("HighAPIErrorRate").alias("rule"), "window_end", (F.col("error_ratio") > 0.2).alias("condition"))
    return lat.unionByName(err)


ALERT_SUSTAINED_SQL = f"""
WITH ev AS (
  SELECT 'HighAPIResponseTime' AS rule, window_end, avg(duration_seconds) > {mt.LATENCY_WARN} AS condition
  FROM {W} GROUP BY window_end
  UNION ALL
  SELECT 'HighAPIErrorRate', window_end, count_if(status >= 500) / count(*) > 0.2 FROM {W} GROUP BY window_end),
b AS (SELECT *, sum(CASE WHEN condition THEN 0 ELSE 1 END) OVER (PARTITION BY rule ORDER BY window_end
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS brk FROM ev),
s AS (SELECT *, min(CASE WHEN condition THEN window_end END) OVER (PARTITION BY rule, brk) AS since FROM b)
SELECT rule, {TS('window_end', 'window_end')}, condition,
  coalesce(condition AND epoch_us(window_end) - epoch_us(since) >= {SUSTAIN_S * 1_000_000}, false) AS firing,
  {TS('CASE WHEN condition THEN since END', 'active_since')}
FROM s"""


@query("alert_sustained", ALERT_SUSTAINED_SQL)
def q_alert_sustained(t):
    return mt.alert_sustained(_evals(t), for_seconds=SUSTAIN_S)


ABSENT_GAP = 86400


@query("metrics_absent", f"""
WITH e AS (SELECT client AS source, CAST(ts AS TIMESTAMP) AS t FROM request_log),
p AS (SELECT source, t AS silent_from, lead(t) OVER (PARTITION BY source ORDER BY t) AS silent_until FROM e
      UNION ALL SELECT source, max(t), TIMESTAMP '{AS_OF_EVENTS}' FROM e GROUP BY source)
SELECT source, {TS('silent_from', 'silent_from')}, {TS('silent_until', 'silent_until')},
  {R('(epoch_us(silent_until) - epoch_us(silent_from)) / 1e6', 'gap_seconds')}
FROM p WHERE silent_until IS NOT NULL AND (epoch_us(silent_until) - epoch_us(silent_from)) / 1e6 > {ABSENT_GAP}""")
def q_metrics_absent(t):
    return mt.metrics_absent(rl(t), "client", gap_seconds=ABSENT_GAP, chunk="1 day", as_of=AS_OF_EVENTS)


def _alerts(t):
    m = mt.mean_latency(rl(t), "1 hour", "1 hour", keys=["endpoint"])
    base = m.select("window_start", "endpoint", "mean_latency")
    warn = base.where(F.col("mean_latency") > mt.LATENCY_WARN).select(
        F.lit("APIResponseTime").alias("alertname"), F.lit("api").alias("component"),
        F.lit("warning").alias("severity"), "window_start", "endpoint")
    crit = base.where(F.col("mean_latency") > mt.LATENCY_CRIT).select(
        F.lit("APIResponseTime").alias("alertname"), F.lit("api").alias("component"),
        F.lit("critical").alias("severity"), "window_start", "endpoint")
    return warn.unionByName(crit)


ALERTS_SQL = f"""
WITH m AS (SELECT window_start, endpoint, avg(duration_seconds) AS ml FROM {windowed_sql('request_log', 3600, 3600)}
           GROUP BY window_start, endpoint),
alerts AS (SELECT 'APIResponseTime' AS alertname, 'api' AS component, 'warning' AS severity, window_start, endpoint
           FROM m WHERE ml > {mt.LATENCY_WARN}
           UNION ALL
           SELECT 'APIResponseTime', 'api', 'critical', window_start, endpoint FROM m WHERE ml > {mt.LATENCY_CRIT})"""


@query("alert_inhibit", ALERTS_SQL + f"""
SELECT alertname, component, severity, {TS('window_start', 'window_start')}, endpoint FROM alerts a
WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM alerts c WHERE c.severity = 'critical'
           AND c.alertname = a.alertname AND c.component = a.component AND c.window_start = a.window_start))""")
def q_alert_inhibit(t):
    return mt.alert_inhibit(_alerts(t))


@query("alert_group", ALERTS_SQL + f""",
x AS (SELECT alertname, 'prod' AS cluster, endpoint AS service, window_start AS ts FROM alerts WHERE severity = 'warning'),
g AS (SELECT x.*, min(ts) OVER (PARTITION BY alertname, cluster, service) AS st FROM x)
SELECT alertname, cluster, service, CAST(floor((epoch_us(ts) - epoch_us(st)) / {int(mt.seconds(mt.REPEAT_INTERVAL) * 1e6)}.0) AS BIGINT) AS span,
  {TS('min(ts)', 'notified_at')}, count(*) AS alerts
FROM g GROUP BY alertname, cluster, service, span""")
def q_alert_group(t):
    a = _alerts(t).where(F.col("severity") == "warning").select(
        "alertname", F.lit("prod").alias("cluster"), F.col("endpoint").alias("service"), F.col("window_start").alias("ts"))
    return mt.alert_group(a)


@query("score_distribution", f"""
SELECT {WSEL}, CAST(least(floor(propensity_score * 10), 9) AS INT) AS bin, count(*) AS count,
  {R('count(*) / 1440.0', 'predictions_per_minute')}
FROM {windowed_sql('(SELECT propensity_score, created_at AS ts FROM predictions)', 86400, 86400)}
GROUP BY window_start, window_end, bin""")
def q_score_distribution(t):
    p = mt.with_event_time(t.predictions().select("propensity_score", F.col("created_at").alias("ts")))
    return mt.score_distribution(p, size="1 day")


@query("feedback_stream_trigger", f"""
SELECT id, {TS('created_at', 'created_at')},
  count(*) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_count,
  count(*) OVER (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 10 AS retrain_triggered
FROM feedback""")
def q_feedback_stream_trigger(t):
    spark = t.spark
    src, per_batch = rn.stage_files(t.feedback().select("id", F.col("created_at").cast("timestamp").alias("created_at")),
                         unique_dir(spark, "feedback-src"), "created_at", parts=4)
    stream = rn.read_stream(spark, src, "id bigint, created_at timestamp", files_per_trigger=per_batch)
    out = rn.feedback_stream_trigger(spark, stream, unique_dir(spark, "feedback-out"))
    return spark.read.parquet(out).select("id", "created_at", "running_count", "retrain_triggered")


@query("live_prediction_feed", f"""
SELECT customer_id, {R('propensity_score', 'propensity_score')}, model_version, {TS('created_at', 'created_at')}, id
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions)
WHERE rn = 1""")
def q_live_prediction_feed(t):
    spark = t.spark
    p = t.predictions().withColumn("created_at", F.col("created_at").cast("timestamp"))
    src, per_batch = rn.stage_files(p, unique_dir(spark, "pred-src"), "created_at", parts=4)
    stream = rn.read_stream(spark, src, p.schema, files_per_trigger=per_batch)
    path = rn.live_prediction_feed(spark, stream, unique_dir(spark, "latest"))
    return rn.read_latest(spark, path).select("customer_id", "propensity_score", "model_version",
                                              "created_at", "id")


WATERMARK = "1 hour"


@query("request_rate_stream", f"""
SELECT {WSEL}, count(*) AS requests, {R(f'count(*) / {float(SIZE_S)}', 'rate_per_s')}
FROM {W} GROUP BY window_start, window_end
HAVING window_end <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM request_log) - INTERVAL {WATERMARK}""")
def q_request_rate_stream(t):
    spark = t.spark
    r = t.request_log().withColumn("ts", F.col("ts").cast("timestamp"))
    src, per_batch = rn.stage_files(r, unique_dir(spark, "requests-src"), "ts", parts=4)
    stream = mt.with_event_time(rn.read_stream(spark, src, r.schema, files_per_trigger=per_batch), watermark=WATERMARK)
    sink = rn.run_available_now(mt.request_rate(stream, SIZE, SLIDE), spark, "request-rate")
    return spark.read.parquet(sink)


@query("alert_sustained_stream", ALERT_SUSTAINED_SQL)
def q_alert_sustained_stream(t):
    """Stream form of alert_sustained: the evaluations are replayed as a file
    stream and labelled by per-rule state."""
    spark = t.spark
    ev = _evals(t).withColumn("window_end", F.col("window_end").cast("timestamp"))
    src, per_batch = rn.stage_files(ev, unique_dir(spark, "evals-src"), "window_end", parts=4)
    stream = rn.read_stream(spark, src, ev.schema, files_per_trigger=per_batch)
    sink = rn.run_available_now(sf.alert_sustained_stream(stream, for_seconds=SUSTAIN_S), spark, "sustained")
    return spark.read.parquet(sink).select("rule", F.col("at").alias("window_end"), "condition", "firing",
                                           "active_since")


@query("metrics_absent_stream", f"""
WITH e AS (SELECT client AS source, CAST(ts AS TIMESTAMP) AS t FROM request_log),
p AS (SELECT source, t AS silent_from, lead(t) OVER (PARTITION BY source ORDER BY t) AS silent_until FROM e)
SELECT source, {TS('silent_from', 'silent_from')}, {TS('silent_until', 'silent_until')},
  {R('(epoch_us(silent_until) - epoch_us(silent_from)) / 1e6', 'gap_seconds')}
FROM p WHERE silent_until IS NOT NULL AND (epoch_us(silent_until) - epoch_us(silent_from)) / 1e6 > {ABSENT_GAP}""")
def q_metrics_absent_stream(t):
    """Stream form of metrics_absent: closed silences between events, from
    per-source state (open silences at the end of the stream are not compared)."""
    spark = t.spark
    r = t.request_log().select("client", F.col("ts").cast("timestamp").alias("ts"))
    src, per_batch = rn.stage_files(r, unique_dir(spark, "absent-src"), "ts", parts=4)
    stream = mt.with_event_time(rn.read_stream(spark, src, r.schema, files_per_trigger=per_batch), watermark="1 hour")
    sink = rn.run_available_now(sf.metrics_absent_stream(stream, gap_seconds=ABSENT_GAP), spark, "absent")
    return spark.read.parquet(sink).where(F.col("silent_until").isNotNull())
