"""The windowed metrics are one function for batch and stream: on the windows a
watermark has closed, the streaming run equals the batch run."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from propel.session import unique_dir
from propel.sources.tables import Tables
from propel.streaming import metrics as mt
from propel.streaming import runner as rn

SIZE, SLIDE, WM = "6 hours", "1 hour", "1 hour"

METRICS = {
    "request_rate": lambda df: mt.request_rate(df, SIZE, SLIDE),
    "status_class_rate": lambda df: mt.status_class_rate(df, SIZE, SLIDE),
    "mean_latency": lambda df: mt.mean_latency(df, SIZE, SLIDE),
    "error_ratio": lambda df: mt.error_ratio(df, SIZE, SLIDE),
    "cache_miss_ratio": lambda df: mt.cache_miss_ratio(df, SIZE),
    "latency_sketch": lambda df: mt.latency_sketch(df, SIZE),
    "endpoint_rate": lambda df: mt.endpoint_rate(df, "^(purchase|click)$", SIZE, SLIDE),
}


@pytest.fixture(scope="module")
def staged(spark):
    r = Tables(spark, SF_SMALL).request_log().withColumn("ts", F.col("ts").cast("timestamp"))
    return (r, *rn.stage_files(r, unique_dir(spark, "metrics-src"), "ts", parts=3))


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(METRICS))
def test_stream_equals_batch_on_closed_windows(spark, staged, name):
    r, src, per_batch = staged
    fn = METRICS[name]
    stream = mt.with_event_time(rn.read_stream(spark, src, r.schema, files_per_trigger=per_batch), watermark=WM)
    sink = rn.run_available_now(fn(stream), spark, f"parity-{name}")
    got = spark.read.parquet(sink)
    cut = r.agg(F.max("ts")).first()[0]
    batch = fn(mt.with_event_time(r))
    closed = batch.where(F.col("window_end") <= F.lit(cut) - F.expr(f"INTERVAL {WM}"))
    assert got.count() > 0
    assert _rows(got.select(*closed.columns)) == _rows(closed)


def test_approx_quantiles_ordered(spark):
    r = mt.with_event_time(Tables(spark, SF_SMALL).request_log())
    q = mt.latency_quantiles_approx(r, size="1 day").collect()
    assert q and all(x.p50 <= x.p95 <= x.p99 for x in q)


def test_windows_copy_panes_not_rows(spark):
    r = mt.with_event_time(Tables(spark, SF_SMALL).request_log())
    for f in (mt.request_rate, mt.status_class_rate, mt.error_ratio):
        plan = f(r, SIZE, SLIDE)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Expand") <= 1 and (plan.find("Expand") < 0 or "Aggregate" in plan[plan.find("Expand"):])   # below it rows are panes already
    odd = _rows(mt.request_rate(r, "90 minutes", "1 hour"))       # no multiple: rows directly
    assert odd and sum(x[2] for x in odd) > 0


def test_sketch_error_bound_and_merge(spark):
    r = mt.with_event_time(Tables(spark, SF_SMALL).request_log())
    by = {}
    for x in r.select("endpoint", "duration_seconds").collect():
        by.setdefault(x[0], []).append(float(x[1]))
    got = {x.endpoint: x for x in mt.sketch_quantiles(mt.merge_sketches(mt.latency_sketch(r, SIZE))).collect()}
    assert set(got) == set(by)
    for e, v in by.items():
        v.sort()
        assert got[e].requests == len(v)
        for q, p in ((0.5, got[e].p50), (0.95, got[e].p95), (0.99, got[e].p99)):
            exact = v[max(-(-int(round(len(v) * q * 1e9)) // 10**9), 1) - 1]
            assert abs(p - exact) <= 0.01 * exact + 1e-12
    halves = mt.latency_sketch(r.where("event_id % 2 = 0"), SIZE).unionByName(mt.latency_sketch(r.where("event_id % 2 = 1"), SIZE))
    assert _rows(mt.sketch_quantiles(mt.merge_sketches(halves))) == _rows(mt.sketch_quantiles(mt.merge_sketches(mt.latency_sketch(r, "1 day"))))
    day = mt.merge_sketches(mt.latency_sketch(r, SIZE), size="1 day")
    assert _rows(day.select("window_start", "endpoint", F.coalesce("bucket", F.lit(-10**6)), "n")) == _rows(
        mt.latency_sketch(r, "1 day").select("window_start", "endpoint", F.coalesce("bucket", F.lit(-10**6)), "n"))
