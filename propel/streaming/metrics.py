"""Windowed service metrics over request rows.

Every metric is one function ``f(df, ...) -> DataFrame`` that works on a batch
DataFrame and, unchanged, on a streaming one (``readStream`` + watermark):
``groupBy(window(ts, size, slide), ...)`` with conditional counts, which
Spark aggregates partially on each task before the shuffle.

Request rows: ``ts``, ``endpoint``, ``status``, ``duration_seconds``,
``cache_hit``, ``client``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propel.functions.core import ts

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
# default latency histogram bucket bounds (seconds) of the metrics client
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
LATENCY_WARN, LATENCY_CRIT = 0.5, 1.0
ERROR_RATE_WARN, ERROR_RATE_CRIT = 0.05, 0.1
SLA_ERROR_RATIO = 0.001
CACHE_MISS_ALERT = 0.3
BATCH_LATENCY_ALERT = 2.0
AVAILABILITY_ALERT = 0.01
ABSENT_SECONDS = 600
REPEAT_INTERVAL = "12 hours"
RETRAIN_AFTER = 10


def seconds(interval: str) -> float:
    n, unit = interval.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return float(n) * mult


def with_event_time(df: DataFrame, col: str = "ts", watermark: str | None = None) -> DataFrame:
    """Event time as TIMESTAMP (``withWatermark`` rejects ``timestamp_ntz``), optional watermark."""
    out = df.withColumn(col, ts(col))
    return out.withWatermark(col, watermark) if watermark else out


def _win(size: str, slide: str | None, col: str = "ts") -> Column:
    return F.window(col, size, slide or size)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                     *[c for c in df.columns if c != "window"])


def _sliding(df: DataFrame, size: str, slide: str | None, keys: Sequence, **sums: Column) -> DataFrame:
    """(window, keys, sums) of sliding windows. Rows are summed once per pane of one slide and
    key; windows add up their panes, so it is panes, not rows, that are copied into each
    window that holds them. A size that is no multiple of the slide sums rows directly.
    In a stream a row counts as long as its pane is open under the watermark."""
    slide = slide or size
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    agg = [F.sum(v).alias(k) for k, v in sums.items()]
    if slide == size or seconds(size) % seconds(slide):
        return df.groupBy(_win(size, slide), *named).agg(*agg)
    panes = df.groupBy(_win(slide, None), *named).agg(*agg)
    names = [c for c in panes.columns if c != "window" and c not in sums]
    panes = panes.select(F.window_time("window").alias("_pane"), *names, *sums)
    return panes.groupBy(F.window("_pane", size, slide).alias("window"), *names).agg(*[F.sum(k).alias(k) for k in sums])


def request_rate(df: DataFrame, size: str = "5 minutes", slide: str = "30 seconds",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Requests per second in each sliding window."""
    g = _sliding(df, size, slide, keys, requests=F.lit(1).cast("long"))
    return _flat(g.withColumn("rate_per_s", F.col("requests") / seconds(size)))


def status_class_rate(df: DataFrame, size: str = "5 minutes", slide: str = "30 seconds") -> DataFrame:
    """Rate per status class (2xx / 4xx / 5xx)."""
    cls = F.concat((F.col("status") / 100).cast("int").cast("string"), F.lit("xx")).alias("status_class")
    g = _sliding(df, size, slide, [cls], requests=F.lit(1).cast("long"))
    return _flat(g.withColumn("rate_per_s", F.col("requests") / seconds(size)))


def endpoint_rate(df: DataFrame, pattern: str, size: str = "5 minutes", slide: str = "30 seconds") -> DataFrame:
    """Rate of requests whose endpoint matches a regex, per endpoint."""
    f = df.where(F.col("endpoint").rlike(pattern))
    return request_rate(f, size, slide, keys=["endpoint"])


def mean_latency(df: DataFrame, size: str = "5 minutes", slide: str = "30 seconds",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Mean duration per window; level warning > 0.5 s, critical > 1 s."""
    # averaged over rows, not panes: a sum of double sums would differ in its last bits
    g = _flat(df.groupBy(_win(size, slide), *keys).agg(F.avg("duration_seconds").alias("mean_latency"),
                                                       F.count(F.lit(1)).alias("requests")))
    lvl = (F.when(F.col("mean_latency") > LATENCY_CRIT, "critical")
           .when(F.col("mean_latency") > LATENCY_WARN, "warning").otherwise("ok"))
    return g.withColumn("level", lvl)


def error_ratio(df: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """5xx share of all requests per window (SLA breach above 0.1%) and the bare 5xx rate."""
    g = _sliding(df, size, slide, [], requests=F.lit(1).cast("long"), errors=F.coalesce((F.col("status") >= 500).cast("long"), F.lit(0).cast("long")))
    return _flat(g).select("*", (F.col("errors") / F.col("requests")).alias("error_ratio"),
                           (F.col("errors") / seconds(size)).alias("error_rate_per_s"),
                           (F.col("errors") / F.col("requests") > SLA_ERROR_RATIO).alias("sla_breach"))


def latency_histogram(df: DataFrame, buckets: Sequence[float] = LATENCY_BUCKETS,
                      keys: Sequence[str] = ("endpoint",), window: tuple[str, str] | None = None) -> DataFrame:
    """Cumulative count per bucket bound (``le``), +Inf included, per key (and window)."""
    grp = list(keys) + ([_win(*window)] if window else [])
    aggs = [F.count_if(F.col("duration_seconds") <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count(F.lit(1)).alias(f"b{len(buckets)}"))
    g = df.groupBy(*grp).agg(*aggs)
    if window:
        g = _flat(g)
    bounds = list(buckets) + [float("inf")]
    arr = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative_count"))
                    for i, b in enumerate(bounds)])
    keep = [c for c in g.columns if not (c.startswith("b") and c[1:].isdigit())]
    return g.select(*keep, F.inline(arr))


def histogram_quantile(hist: DataFrame, q: float, keys: Sequence[str]) -> DataFrame:
    """Quantile by linear interpolation inside histogram buckets (cumulative rows ``le``,
    ``cumulative_count``). Ranks in the +Inf bucket return the highest finite bound."""
    w = Window.partitionBy(*keys).orderBy("le")
    h = (hist.withColumn("_prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
         .withColumn("_prev_c", F.coalesce(F.lag("cumulative_count").over(w), F.lit(0)))
         .withColumn("_total", F.max("cumulative_count").over(Window.partitionBy(*keys))))
    rank = F.col("_total") * q
    h = h.where((F.col("cumulative_count") >= rank) & (F.col("_total") > 0))
    first = h.groupBy(*keys).agg(F.min_by(F.struct("le", "_prev_le", "_prev_c", "cumulative_count", "_total"),
                                          F.col("le")).alias("_b"))
    b = F.col("_b")
    into_bucket = b["_total"] * q - b["_prev_c"]
    inside = b["_prev_le"] + (b["le"] - b["_prev_le"]) * into_bucket / (b["cumulative_count"] - b["_prev_c"])
    # a rank in the +Inf bucket returns the highest finite bound
    val = F.when(b["le"] == float("inf"), b["_prev_le"]).otherwise(inside)
    return first.select(*keys, val.alias(f"p{int(round(q * 100))}"))


def latency_quantiles(df: DataFrame, qs: Sequence[float] = (0.5, 0.95, 0.99), keys: Sequence[str] = ("endpoint",),
                      buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """p50/p95/p99 from the bucket counts (the histogram_quantile form)."""
    hist = latency_histogram(df, buckets, keys)
    out = None
    for q in qs:
        r = histogram_quantile(hist, q, keys)
        out = r if out is None else out.join(r, list(keys))
    return out


def latency_quantiles_approx(df: DataFrame, qs: Sequence[float] = (0.5, 0.95, 0.99),
                             size: str = "5 minutes", slide: str | None = None,
                             keys: Sequence[str] = ()) -> DataFrame:
    """Approximate quantiles per window (stream-friendly ``percentile_approx``)."""
    g = df.groupBy(_win(size, slide), *keys).agg(
        F.percentile_approx("duration_seconds", list(qs), 10000).alias("_q"))
    return _flat(g).select("*", *[F.col("_q")[i].alias(f"p{int(round(q * 100))}") for i, q in enumerate(qs)]
                           ).drop("_q")


def latency_sketch(df: DataFrame, size: str = "5 minutes", keys: Sequence[str] = ("endpoint",), error: float = 0.01,
                   col: str = "duration_seconds") -> DataFrame:
    """Mergeable latency sketch: rows (window_start, window_end, keys, bucket, n). Bucket b holds the
    durations in (g**(b-1), g**b] with g = (1 + error) / (1 - error), so any quantile of it is within the
    relative ``error``; null bucket: durations of zero or less. Sketches merge by adding n, over
    windows, keys or batches (:func:`merge_sketches`)."""
    g = (1 + error) / (1 - error)
    v = F.col(col).cast("double")
    b = F.when(v > 0, F.ceil(F.log(v) / F.log(F.lit(g)))).cast("long").alias("bucket")
    return _flat(df.where(F.col(col).isNotNull()).groupBy(_win(size, None), *keys, b).agg(F.count(F.lit(1)).alias("n")))


def merge_sketches(sketch: DataFrame, keys: Sequence[str] = ("endpoint",), size: str | None = None) -> DataFrame:
    """Sketch rows per ``keys`` over all windows, or over windows of ``size``."""
    if size is None:
        return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    return _flat(sketch.groupBy(F.window("window_start", size).alias("window"), *keys, "bucket").agg(F.sum("n").alias("n")))


def sketch_quantiles(sketch: DataFrame, qs: Sequence[float] = (0.5, 0.95, 0.99), keys: Sequence[str] = ("endpoint",), error: float = 0.01) -> DataFrame:
    """Quantiles (rank ceil(q * n)) within the relative ``error``. Buckets per key are few: the
    logarithm of the range of durations over log g."""
    g = (1 + error) / (1 - error)
    w = Window.partitionBy(*keys)
    at = w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    s = sketch.withColumn("_cum", F.sum("n").over(at)).withColumn("_all", F.sum("n").over(w))
    mid = F.coalesce(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1), F.lit(0.0))
    need = [F.greatest(F.ceil(F.col("_all") * F.lit(float(q))), F.lit(1)) for q in qs]
    return s.groupBy(*keys).agg(F.max("_all").alias("requests"),
                                *[F.min(F.when(F.col("_cum") >= n, mid)).alias(f"p{int(round(q * 100))}") for q, n in zip(qs, need)])


def cache_miss_ratio(df: DataFrame, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    g = df.groupBy(_win(size, slide)).agg(F.count_if(F.col("cache_hit")).alias("hits"),
                                          F.count_if(~F.col("cache_hit")).alias("misses"))
    r = F.try_divide(F.col("misses").cast("double"), (F.col("hits") + F.col("misses")).cast("double"))
    return _flat(g).select("*", r.alias("miss_ratio"), (r > CACHE_MISS_ALERT).alias("alert"))


def batch_latency(df: DataFrame, batch_pattern: str, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Mean duration of batch endpoints per window, alert above 2 s."""
    g = df.where(F.col("endpoint").rlike(batch_pattern)).groupBy(_win(size, slide)).agg(
        F.avg("duration_seconds").alias("mean_batch_latency"), F.count(F.lit(1)).alias("requests"))
    return _flat(g).withColumn("alert", F.col("mean_batch_latency") > BATCH_LATENCY_ALERT)


def availability_ratio(df: DataFrame, sample: str = "1 minute", size: str = "1 hour",
                       slide: str | None = None) -> DataFrame:
    """Share of down samples per window; a sample (time bucket) is down when no
    request in it succeeded (all 5xx). Alert above 1%. Reads finished samples."""
    s = df.groupBy(F.window("ts", sample).alias("_s")).agg(
        (F.count_if(F.col("status") < 500) == 0).alias("_down"))
    s = s.select(F.col("_s.start").alias("ts"), "_down")
    g = s.groupBy(_win(size, slide)).agg(F.count(F.lit(1)).alias("samples"),
                                         F.count_if("_down").alias("down_samples"))
    return _flat(g).select("*", (F.col("down_samples") / F.col("samples")).alias("down_ratio"),
                           (F.col("down_samples") / F.col("samples") > AVAILABILITY_ALERT).alias("alert"))


def score_distribution(df: DataFrame, score: str = "propensity_score", bins: int = 10,
                       size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Histogram of scores per window (bins of width 1/bins, last closed) and predictions per minute."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(_win(size, slide), b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return _flat(g).withColumn("predictions_per_minute", F.col("count") / (seconds(size) / 60.0))


# ---------------------------------------------------------------------------
# alerts over finished window rows (batch, or inside foreachBatch)
# ---------------------------------------------------------------------------
def alert_sustained(evals: DataFrame, rule: str = "rule", at: str = "window_end", cond: str = "condition",
                    for_seconds: float = 300) -> DataFrame:
    """Fire only when the condition has held for ``for_seconds``: gaps and islands
    per rule over its evaluation times (rows per rule grow with time, not data)."""
    w = Window.partitionBy(rule).orderBy(at)
    x = evals.withColumn("_breaks", F.sum(F.when(F.col(cond), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    wi = Window.partitionBy(rule, "_breaks")
    x = x.withColumn("_since", F.min(F.when(F.col(cond), F.col(at))).over(wi))
    held = F.unix_micros(ts(at)) - F.unix_micros(ts("_since"))
    return (x.withColumn("firing", F.coalesce(F.col(cond) & (held >= for_seconds * 1e6), F.lit(False)))
            .withColumn("active_since", F.when(F.col(cond), F.col("_since"))).drop("_breaks", "_since"))


def metrics_absent(events: DataFrame, source: str = "client", ts_col: str = "ts", gap_seconds: float = ABSENT_SECONDS,
                   chunk: str = "1 day", as_of: str | None = None) -> DataFrame:
    """Silences longer than ``gap_seconds`` per source: (source, silent_from, silent_until, gap).

    Consecutive events are paired inside (source, time chunk) partitions, and
    across chunks through one row per non-empty chunk, so a source that holds
    a large share of all events is still split over many tasks.
    """
    e = events.select(F.col(source).alias("source"), ts(ts_col).alias("t"))
    chunk_us = int(seconds(chunk) * 1e6)
    e = e.withColumn("_chunk", F.floor(F.unix_micros("t") / chunk_us))
    w = Window.partitionBy("source", "_chunk").orderBy("t")
    inner = e.withColumn("_next", F.lead("t").over(w)).where(F.col("_next").isNotNull()).select(
        "source", F.col("t").alias("silent_from"), F.col("_next").alias("silent_until"))
    ends = e.groupBy("source", "_chunk").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    wc = Window.partitionBy("source").orderBy("_chunk")
    across = ends.withColumn("_next_first", F.lead("_first").over(wc)).where(F.col("_next_first").isNotNull()).select(
        "source", F.col("_last").alias("silent_from"), F.col("_next_first").alias("silent_until"))
    gaps = inner.unionByName(across)
    if as_of is not None:
        tail = ends.groupBy("source").agg(F.max("_last").alias("silent_from")).withColumn(
            "silent_until", F.lit(as_of).cast("timestamp"))
        gaps = gaps.unionByName(tail)
    gap = (F.unix_micros("silent_until") - F.unix_micros("silent_from")) / 1e6
    return gaps.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > gap_seconds)


SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}


def alert_inhibit(alerts: DataFrame, equal: Sequence[str] = ("alertname", "component"),
                  at: Sequence[str] = ("window_start",)) -> DataFrame:
    """Drop warnings while a critical with equal labels fires, and infos while a warning does."""
    keys = list(equal) + list(at)
    out = alerts
    for src, tgt in (("critical", "warning"), ("warning", "info")):
        s = alerts.where(F.col("severity") == src).select(*keys).distinct()
        t_rows = out.where(F.col("severity") == tgt).join(s, keys, "left_anti")
        out = out.where(F.col("severity") != tgt).unionByName(t_rows)
    return out


def alert_group(alerts: DataFrame, group: Sequence[str] = ("alertname", "cluster", "service"), at: str = "ts",
                repeat: str = REPEAT_INTERVAL) -> DataFrame:
    """One notification per group and per repeat span counted from the group's first alert."""
    g = list(group)
    start = alerts.groupBy(*g).agg(F.min(ts(at)).alias("_start"))
    x = alerts.join(start, g)
    span = F.floor((F.unix_micros(ts(at)) - F.unix_micros("_start")) / (seconds(repeat) * 1e6)).cast("long")
    return (x.withColumn("span", span).groupBy(*g, "span")
            .agg(F.min(ts(at)).alias("notified_at"), F.count(F.lit(1)).alias("alerts")))
