"""Sharding by a hypergeometric communication matrix (law ``rows``).

The rows are written once, which fixes partition p and position of each. For every
partition the exact counts it sends to each shard are drawn from the multivariate
hypergeometric law of the places still free, so shard sizes are exact. Each
partition permutes its rows locally and deals them out by its counts; rows are
exchanged by (shard, block of the second permutation) and permuted again, which
gives the slot. Equal texts are not kept together: the shuffle is uniform, and repeated rows,
ties and nulls in any column are rows like all others. An empty table gives an empty
result. Columns of ``docs`` are carried untouched, whatever their names (but for ``shard``
and ``slot``, which the result replaces).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propel.llm.common import cut

BLOCK = 2048


def draw(rng, good: int, total: int, n: int) -> int:
    """One hypergeometric draw by inverting its distribution near the mean; any magnitude."""
    lo, hi = max(0, n - (total - good)), min(n, good)
    if lo >= hi:
        return lo
    mean = n * good / total
    sd = max(1.0, np.sqrt(mean * (1 - good / total) * max(total - n, 1) / max(total - 1, 1)))
    a, b = max(lo, int(mean - 40 * sd) - 2), min(hi, int(mean + 40 * sd) + 2)
    k = np.arange(a, b, dtype=float)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(total - good - n + k + 1)
    p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(p - p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: source partitions; columns: shards; column sums differ by at most one."""
    total = int(sum(counts))
    free = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng, out = np.random.default_rng(seed), np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        left, rest = int(n), int(free.sum())
        for s in range(shards):
            c = draw(rng, int(free[s]), rest, left) if left else 0
            out[p, s] = c
            left, rest = left - c, rest - int(free[s])
        free -= out[p]
    return out


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """``docs`` plus shard (int) and slot (long, gapless from 0 in each shard)."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    rows = cut(docs.select(F.struct(*own).alias("doc"), F.monotonically_increasing_id().alias("rid")), "shard-rows")
    part = F.shiftright("rid", 33)
    got = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row a partition
    sc = docs.sparkSession.sparkContext
    where = sc.broadcast(({r.p: (i, r.n) for i, r in enumerate(got)}, matrix([r.n for r in got], shards, seed)))

    last = {}       # the permutation of the partition at hand, made once in a worker

    @F.pandas_udf("int")
    def deal(rid: pd.Series) -> pd.Series:
        index, m = where.value
        rid = rid.to_numpy()
        p, out = rid >> 33, np.zeros(len(rid), np.int32)
        for q in np.unique(p):
            if q not in last:
                i, n = index[int(q)]
                last.clear()
                perm = np.random.default_rng([seed, int(q)]).permutation(n)  # local permutation
                last[q] = np.searchsorted(np.cumsum(m[i]), perm, side="right").astype(np.int32)
            at = p == q
            out[at] = last[q][rid[at] & ((1 << 33) - 1)]
        return pd.Series(out)

    total = sum(r.n for r in got)
    blocks = max(1, -(-total // (shards * BLOCK)))
    key = F.xxhash64("rid", F.lit(seed))
    d = rows.withColumn("shard", deal("rid")).withColumn("key", key).withColumn("block", F.pmod("key", F.lit(blocks)))
    w = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    start = cut(d.groupBy(F.col("shard").alias("s"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("n")), "shard-blocks")
    start = start.select("s", "b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("o"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "rid"))  # second permutation
    d = d.withColumn("rank", rank).join(start, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    return d.select("doc.*", "shard", (F.col("o") + F.col("rank") - 1).cast("long").alias("slot"))
