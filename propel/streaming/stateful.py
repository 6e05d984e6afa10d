"""Per-key state over event streams: sustained alerts and absent sources."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from propel.functions.core import ts


def _micros(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").astype("int64").to_numpy()


# ---- streaming forms of the alert operators -------------------------------------------
def alert_sustained_stream(evals: DataFrame, rule: str = "rule", at: str = "window_end", cond: str = "condition",
                           for_seconds: float = 300) -> DataFrame:
    """Per-rule state (start of the current true run) across micro-batches: a
    rule fires once its condition has held for ``for_seconds``. Same rows as the
    batch gaps-and-islands form over the same evaluations."""
    for_us = int(for_seconds * 1e6)
    x = evals.select(F.col(rule).alias("rule"), ts(at).alias("at"), F.col(cond).alias("condition"))
    out_schema = "rule string, at timestamp, condition boolean, firing boolean, active_since timestamp"

    def fn(k, pdfs, state: GroupState):
        since = state.get[0] if state.exists else None
        for pdf in pdfs:
            pdf = pdf.sort_values("at").reset_index(drop=True)
            t = _micros(pdf["at"])
            firing, active = [], []
            for ti, c in zip(t, pdf["condition"].to_numpy()):
                if c:
                    since = ti if since is None else since
                    firing.append(ti - since >= for_us)
                    active.append(since)
                else:
                    since = None
                    firing.append(False)
                    active.append(None)
            pdf["firing"] = firing
            pdf["active_since"] = pd.to_datetime(pd.Series(active, dtype="float64"), unit="us")
            state.update((None if since is None else int(since),))
            yield pdf[["rule", "at", "condition", "firing", "active_since"]]
    return x.groupBy("rule").applyInPandasWithState(fn, out_schema, "since bigint", "append",
                                                    GroupStateTimeout.NoTimeout)


def metrics_absent_stream(events: DataFrame, source: str = "client", ts_col: str = "ts",
                          gap_seconds: float = 600.0, buckets: int = 1024) -> DataFrame:
    """Per-source state (time of the last event): each new event that comes more
    than ``gap_seconds`` after the previous one closes a silence row. With a
    watermark on ``ts_col``, a source still silent when the watermark passes
    ``last + gap`` emits an open row (``silent_until`` NULL) through an
    event-time timeout.

    The sources of a hash bucket share one state (two sorted columns: source, last
    event), so a micro-batch costs one call per bucket, not one per source."""
    gap_us = int(gap_seconds * 1e6)
    t_col = F.col(ts_col) if dict(events.dtypes)[ts_col] == "timestamp" else ts(ts_col)  # keep the watermark
    s = F.col(source).cast("bigint")
    x = events.select(F.when(s.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(s), F.lit(buckets))).cast("int").alias("bucket"),
                      F.coalesce(s, F.lit(0)).alias("source"), t_col.alias("t")).where(F.col("t").isNotNull())
    out_schema = "source bigint, silent_from timestamp, silent_until timestamp, gap_seconds double"

    def fn(k, pdfs, state: GroupState):
        old, last = (np.frombuffer(v, np.int64) for v in state.get) if state.exists else (np.zeros(0, np.int64),) * 2
        got = [] if state.hasTimedOut else [(p["source"].to_numpy(np.int64), _micros(p["t"])) for p in pdfs]
        src, t = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (zip(*got) if got else ((), ())))
        at = np.minimum(np.searchsorted(old, src), max(len(old) - 1, 0))
        seen = old[at] == src if len(old) else np.zeros(len(src), bool)
        if len(old):
            t = np.where(seen, np.maximum(t, last[at]), t)       # an event before the last one changes nothing
        met = np.isin(old, src)
        src, t = np.append(old[met], src), np.append(last[met], t)
        order = np.lexsort((t, src))
        src, t = src[order], t[order]
        gap = np.flatnonzero((src[1:] == src[:-1]) & (t[1:] - t[:-1] > gap_us))
        ends = np.flatnonzero(np.append(src[1:] != src[:-1], True)) if len(src) else np.zeros(0, np.int64)
        try:
            now = state.getCurrentWatermarkMs()
        except Exception:  # no watermark on the input: gaps are emitted on the next event only
            now = None
        gone = ~met & (last // 1000 + gap_us // 1000 < now) if now is not None else np.zeros(len(old), bool)
        keep = ~met & ~gone
        src_now, t_now = np.append(old[keep], src[ends]), np.append(last[keep], t[ends])
        if len(src_now):
            order = np.argsort(src_now)
            state.update((src_now[order].tobytes(), t_now[order].tobytes()))
            if now is not None:
                state.setTimeoutTimestamp(max(int(t_now.min() // 1000) + gap_us // 1000, now + 1))
        else:
            state.remove()
        n = len(gap) + int(gone.sum())
        if n:
            until = np.append(t[gap + 1].astype("datetime64[us]"), np.full(n - len(gap), np.datetime64("NaT", "us")))
            yield pd.DataFrame({"source": [None] * n if k[0] < 0 else np.append(src[gap], old[gone]),
                                "silent_from": np.append(t[gap], last[gone]).astype("datetime64[us]"), "silent_until": until,
                                "gap_seconds": np.append((t[gap + 1] - t[gap]) / 1e6, np.full(n - len(gap), np.nan))})
    return x.groupBy("bucket").applyInPandasWithState(fn, out_schema, "source binary, last binary", "append",
                                                      GroupStateTimeout.EventTimeTimeout)
