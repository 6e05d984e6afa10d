"""Centroid clustering over a vector-approximation (VA) file.

1. Vectors become integers floor(scale * x). Per dimension, edges that hold about equal
   numbers of vectors (from a histogram of all vectors) give 2**BITS cells; a row
   keeps one cell number per dimension beside its full vector, written once.
2. In every round a table per centroid, dimension and cell holds the least and the
   largest squared difference. Their sums over the dimensions bound a vector's distance to
   each centroid. Where one centroid's upper bound lies below all other lower bounds,
   the cells decide; only where the intervals overlap is the full vector fetched and
   compared exactly (integers, ties to the smaller number).
3. Sums and counts are kept from round to round. A vector that the cells give to the same
   centroid as in the last round changes nothing, so only the vectors that move or
   overlap reach the exact step; their differences are summed in tasks and grouped
   (clusters x dimensions numbers reach the driver).

Vectors with another number of components, or with a null or non-finite one, are left
out. Repeated rows are vectors of their own. With fewer than ``k`` vectors each is a
centroid. An empty table gives an empty result. Columns of the input are carried
untouched, whatever their names (but for the five results). The seeds are the smallest
hashes of the id (missing: empty text), equal ones in the order of vector and row.
Distances are 64-bit integers: components must stay below 2**27 after scaling, a
larger one raises an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.llm.common import cut, with_fields

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024.0, 3
BITS, BINS = 6, 1024
LARGEST = 1 << 27


def _integers(col, dim: int, scale: float) -> np.ndarray:
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = np.floor(v * scale)
    if len(v) and np.abs(v).max() >= LARGEST:
        raise ValueError("a component is too large for 64-bit distances")
    return v.astype(np.int64)


def _range_batches(dim, scale):
    def run(batches):
        for b in batches:
            if b.num_rows:
                v = _integers(b.column(0), dim, scale)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(v.min(0)), pa.array(v.max(0))], ["d", "lo", "hi"])
    return run


def _bin(v, lo, hi):
    return (v - lo) * BINS // (hi - lo + 1)


def _histogram_batches(dim, scale, lo, hi):
    def run(batches):
        n = np.zeros(dim * BINS, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount((np.arange(dim) * BINS + _bin(_integers(b.column(0), dim, scale), lo, hi)).ravel(), minlength=dim * BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])
    return run


def edges(vectors: DataFrame, dim: int, scale: float, bits: int = BITS) -> np.ndarray | None:
    """(dim, 2**bits + 1) first integers of the cells, the last one behind the largest value."""
    r = vectors.mapInArrow(_range_batches(dim, scale), "d long, lo long, hi long")
    r = r.groupBy("d").agg(F.min("lo"), F.max("hi")).orderBy("d").collect()         # dim rows
    if not r:
        return None
    lo, hi = np.array([x[1] for x in r]), np.array([x[2] for x in r])
    h = vectors.mapInArrow(_histogram_batches(dim, scale, lo, hi), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(dim * BINS)
    for x in h:                                                                      # at most dim * BINS rows
        n[x.at] = x.n
    share = np.cumsum(n.reshape(dim, BINS), axis=1)
    share /= share[:, -1:]
    cells = 1 << bits
    out = np.zeros((dim, cells + 1), np.int64)
    for d in range(dim):
        at = np.searchsorted(share[d], np.arange(1, cells) / cells) + 1              # bins up to here hold the share
        out[d, 0], out[d, -1] = lo[d], hi[d] + 1
        out[d, 1:-1] = lo[d] + -(-at * (hi[d] - lo[d] + 1) // BINS)                  # first value of that bin
    return out


def _cell_batches(dim, scale, edge):
    def run(batches):
        for b in batches:
            v = _integers(b.column(2), dim, scale) if b.num_rows else np.zeros((0, dim), np.int64)
            c = np.stack([np.searchsorted(edge[d, 1:-1], v[:, d], side="right") for d in range(dim)], axis=1).astype(np.uint8)
            own = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (c, v.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(b.columns[:2] + own, ["doc", "id", "cells", "x"])
    return run


def bounds(edge: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dim, cells, k) least and largest squared difference of a cell to a centroid's component."""
    first, last, c = edge[:, :-1, None], edge[:, 1:, None] - 1, centroids.T[:, None, :]
    last = np.maximum(first, last)
    low = np.maximum(0, np.maximum(first - c, c - last))
    high = np.maximum(np.abs(first - c), np.abs(last - c))
    return low * low, high * high


def decide(cells: np.ndarray, tables) -> np.ndarray:
    """The centroid that the cells prove nearest, -1 where the intervals overlap."""
    low, high = (sum(t[d][cells[:, d]] for d in range(cells.shape[1])) for t in tables)
    best = np.argmin(high, axis=1)
    rows = np.arange(len(cells))
    top = high[rows, best][:, None]
    other = np.arange(low.shape[1])[None, :]
    clear = (top < low) | ((top == low) & (best[:, None] < other)) | (best[:, None] == other)
    return np.where(clear.all(1), best, -1)


def _matrix(col, kind, dim) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset:]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]] if len(col) else np.zeros(0, np.uint8)
    return data.view(kind).reshape(-1, dim)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) by exact integers; ties to the smaller number."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def _open(bc, dim):
    """Whether a vector may move: its cells do not give it to one centroid in both rounds."""
    @F.arrow_udf("boolean")
    def may_move(cells: pa.Array) -> pa.Array:
        last, now = bc.value[:2]
        c = _matrix(cells, np.uint8, dim)
        if not len(c):
            return pa.array([], pa.bool_())
        a, b = decide(c, last), decide(c, now)
        return pa.array((a < 0) | (a != b))
    return may_move.asNondeterministic()     # keeps the filter from running it twice


def _move_batches(bc, dim):
    def run(batches):
        last, now = bc.value[-2:]
        k = len(now)
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), np.int32, dim).astype(np.int64)
                new = nearest(x, now)[0]
                old = nearest(x, last)[0] if last is not None else np.full(len(x), -1)
                moved = new != old
                for c in range(k):
                    come, go = moved & (new == c), moved & (old == c)
                    n[c] += come.sum() - go.sum()
                    s[c] += x[come].sum(0) - x[go].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dim + 1)), pa.array(np.tile(np.arange(dim + 1), k)),
                                          pa.array(np.concatenate([s, n[:, None]], axis=1).ravel())], ["c", "d", "v"])
    return run


def _last_batches(bc, dim):
    def run(batches):
        for b in batches:
            best, dist = nearest(_matrix(b.column(1), np.int32, dim).astype(np.int64), bc.value) if b.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(dist)], ["doc", "cluster", "distance"])
    return run


def whole(col: str, dim: int):
    """The vectors with ``dim`` components, none of them null or non-finite."""
    v = F.col(f"`{col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS,
            scale: float = SCALE, seed: int = SEED, keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """The columns ``keep`` (all by default) of every whole vector plus __cluster, __distance,
    __cluster_inertia, __inertia and __centroid_sha256."""
    spark = vectors.sparkSession
    src = vectors.where(whole(vec_col, dim)).select(
        F.struct(*[F.col(f"`{c}`") for c in (vectors.columns if keep is None else keep)]).alias("doc"), F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    edge = edges(src.select("v"), dim, scale, bits)
    if edge is None:
        edge = np.tile(np.arange((1 << bits) + 1), (dim, 1))
    t = cut(src.mapInArrow(_cell_batches(dim, scale, edge), with_fields(src.drop("v").schema, "cells binary, x binary"))
            .withColumn("row", F.monotonically_increasing_id()), "va-file")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = t.select(h.alias("h"), "x", "row").orderBy("h", "x", "row").limit(k).collect()     # k vectors
    now = np.array([np.frombuffer(r.x, np.int32) for r in first], np.int64).reshape(len(first), dim)
    last, total = None, np.zeros((len(first), dim + 1), np.int64)
    for _ in range(rounds if len(first) else 0):
        moving = t
        if last is not None:
            tables = spark.sparkContext.broadcast((bounds(edge, last), bounds(edge, now)))       # dim x cells x k numbers
            moving = t.where(_open(tables, dim)(F.col("cells")))
        both = spark.sparkContext.broadcast((last, now))
        diff = moving.select("x").mapInArrow(_move_batches(both, dim), "c long, d long, v long").groupBy("c", "d").agg(F.sum("v").alias("v"))
        for r in diff.collect():                                                                 # k * (dim + 1) numbers
            total[r.c, r.d] += r.v
        last, now = now, np.where(total[:, -1:] > 0, total[:, :-1] // np.maximum(total[:, -1:], 1), now)
        if (last == now).all():
            break
    fin = cut(t.select("doc", "x").mapInArrow(_last_batches(spark.sparkContext.broadcast(now), dim),
                                              with_fields(t.select("doc").schema, "cluster int, distance long")), "clusters")
    per = {r.cluster: r.s for r in fin.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}    # k rows
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    named = spark.createDataFrame([(c, per.get(c, 0), sum(per.values()), s) for c, s in enumerate(sha)] or [(0, 0, 0, "")],
                                  "cluster int, inertia_c long, inertia long, sha string")
    j = fin.join(F.broadcast(named), "cluster")                                                   # k rows
    return j.select("doc.*", F.col("cluster").alias("__cluster"), F.col("distance").alias("__distance"),
                    F.col("inertia_c").alias("__cluster_inertia"), F.col("inertia").alias("__inertia"), F.col("sha").alias("__centroid_sha256"))
