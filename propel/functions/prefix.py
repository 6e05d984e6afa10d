"""Running totals over a global order without a single-partition window.

A ``Window.orderBy(x)`` with no partition key moves every row into one task.
Instead rows are dealt into ranges of the whole order tuple (so equal leading
keys are split too), as many as the row count asks for, and written once. Running sums
are taken inside each range in parallel, and the totals of the ranges, one row
each, are prefixed and added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows per range that a task sorts and sums
ROWS_PER_RANGE = 1_000_000
#: ranges up to which their totals are broadcast
BROADCAST_RANGES = 1 << 16


def ranges(df: DataFrame, order: Sequence[str], buckets: int | None = None, out: str = "_bucket") -> tuple[DataFrame, int]:
    """``df`` plus the order-preserving number of its range of ``order``, written once; and how many there are."""
    from propel.session import materialize
    if buckets is None:
        # the count decides how many ranges there are; at least one per core
        buckets = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_RANGE))
    return materialize(df.repartitionByRange(buckets, *[F.col(c) for c in order]).withColumn(out, F.spark_partition_id())), buckets


def running_sums(df: DataFrame, order: Sequence[str], values: Sequence[str], buckets: int | None = None,
                 inclusive: bool = True, prefix: str = "cum_", group: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<v>`` = sum of v over all rows ordered before (and, if inclusive,
    including) each row under the total order ``order`` (make it unique),
    separately per ``group`` when given."""
    g = list(group)
    b, n = ranges(df, [*order, *g], buckets)
    w = Window.partitionBy(*g, "_bucket").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    tot = b.groupBy(*g, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # one row per range (and group): the window over them is small
    wt = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*g, "_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(wt), F.lit(0)).alias(f"_off_{v}")
                                      for v in values])
    for v in values:
        b = b.withColumn(f"_in_{v}", F.coalesce(F.sum(v).over(frame), F.lit(0)))
    j = b.join(F.broadcast(tot) if not g and n <= BROADCAST_RANGES else tot, [*g, "_bucket"])
    for v in values:
        j = j.withColumn(f"{prefix}{v}", F.col(f"_in_{v}") + F.col(f"_off_{v}"))
    return j.drop("_bucket", *[f"_in_{v}" for v in values], *[f"_off_{v}" for v in values])
