"""One state per bucket of sources."""

import datetime

from propel.session import unique_dir
from propel.streaming import metrics as mt
from propel.streaming import runner as rn
from propel.streaming import stateful as sf


def test_absent_sources_share_state_by_bucket(spark, monkeypatch):
    t0, s = datetime.datetime(2024, 1, 1), datetime.timedelta(seconds=1)
    rows = [(c, t0 + (i * 7000 + (c or 0) * 13) * s) for c in [*range(40), None] for i in range(6)]
    rows += [(99, t0 + 5 * s), (7, t0 + 13 * 7 * s + 100 * s), (None, None), (3, None)]
    e = spark.createDataFrame(rows, "client bigint, ts timestamp")
    src, k = rn.stage_files(e, unique_dir(spark, "absent"), "ts", parts=3)
    stream = mt.with_event_time(rn.read_stream(spark, src, e.schema, k), watermark="1 hour")
    out = sf.metrics_absent_stream(stream, gap_seconds=600.0, buckets=4)
    got = spark.read.parquet(rn.run_available_now(out, spark, "absent")).collect()
    want = []
    for c in {x for x, _ in rows}:
        ts = sorted(t for x, t in rows if x == c and t is not None)
        want += [(c, a, b, (b - a).total_seconds()) for a, b in zip(ts, ts[1:]) if (b - a).total_seconds() > 600]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got if r.silent_until), key=key) == sorted(want, key=key)
    assert [(r.source, r.silent_from, r.gap_seconds) for r in got if r.silent_until is None and r.source == 99] == [(99, t0 + 5 * s, None)]
