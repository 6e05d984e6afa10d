"""Exact quantiles (linear interpolation, like pandas / DuckDB ``quantile_cont``)
computed without buffering a column in one task.

Spark's exact ``percentile`` merges a value->count map of the whole column
(or group) in a single reducer. Here the column is reduced to distinct values
with counts (a shuffle on the value), the count of values strictly below each
distinct value comes from the two-level running sum of
:mod:`propel.functions.prefix`, and the rows holding the wanted ranks are
picked by a filter inside one more partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.functions.prefix import running_sums


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], group: Sequence[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """One row (per group) with columns q0..q{len(qs)-1}; NULL on empty input."""
    g = list(group)
    v = (df.where(F.col(col).isNotNull()).select(*g, F.col(col).cast("double").alias("_v"))
         .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c")))
    # the (value, count) table feeds the bucket bounds, the running counts and the
    # totals: cut lineage once instead of re-aggregating the source three times
    from propel.session import materialize
    v = materialize(v)
    r = running_sums(v, ["_v"], ["_c"], buckets=buckets, inclusive=False, group=g)  # cum__c: values below
    n = v.groupBy(*g).agg(F.sum("_c").alias("_n"))
    j = r.join(n, g) if g else r.crossJoin(F.broadcast(n))
    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("_n") - 1) * float(q)
        lo, hi = F.floor(h), F.ceil(h)
        inside = lambda k: (F.col("cum__c") <= k) & (k < F.col("cum__c") + F.col("_c"))
        aggs += [F.max(F.when(inside(lo), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(inside(hi), F.col("_v"))).alias(f"_hi{i}"),
                 F.max(h - lo).alias(f"_d{i}")]
    a = j.groupBy(*g).agg(*aggs)
    out = [F.col(c) for c in g]
    for i in range(len(qs)):
        lo_v, hi_v, d = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_d{i}")
        out.append((lo_v + (hi_v - lo_v) * d).alias(f"q{i}"))
    # without groups the aggregate is global: exactly one row, NULLs when empty
    return a.select(*out)


def quantile(df: DataFrame, col: str, q: float, group: Sequence[str] = (), alias: str = "q") -> DataFrame:
    return exact_quantiles(df, col, [q], group).withColumnRenamed("q0", alias)
