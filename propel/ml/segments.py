"""k-means and k-prototypes of many starts at once.

All starts share each pass over the table: one grouped aggregate per round sums
coordinates and counts by (start, cluster), so ten starts cost as many jobs as one.
Numeric columns move to means, categorical ones to modes; the distance is squared
difference plus ``gamma`` per differing category. Seeds come by k-means||: a few passes
sample rows in proportion to their distance, and the weighted candidates (a bounded
number) are reduced to k on the driver. Sums are integers in steps of 2**-20, so
results do not depend on the order of rows; draws come from hashes of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from propel.session import unique_dir

STEP = float(1 << 20)
ROUNDS, TOLERANCE = 40, 1e-4
#: sampling passes of the seeding, and expected candidates per pass and cluster
PASSES, OVERSAMPLE = 3, 2


def _table(df: DataFrame, key: str, cols: Sequence[str], cats: Sequence[str]) -> DataFrame:
    """(h, x, c) written once: hash of the key, numbers and category hashes as binary."""
    src = df.select(F.struct(F.col(f"`{key}`")).alias("row"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"),
                    F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols]).alias("x"),
                    F.array(*[F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in cats]).cast("array<bigint>").alias("c"))

    def pack(batches):
        for b in batches:
            x = [np.rint(np.array(v, float) * STEP).astype(np.int64).tobytes() for v in b.column(2).to_pylist()]
            c = [np.array(v, np.int64).tobytes() for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(x, pa.binary()), pa.array(c, pa.binary())], ["row", "h", "x", "c"])
    path = unique_dir(df.sparkSession, "segments")
    src.mapInArrow(pack, StructType([src.schema["row"], *StructType.fromDDL("h long, x binary, c binary").fields])).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _arrays(batch, nx: int, nc: int):
    n = batch.num_rows
    x, c = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64) for i in (1, 2))
    return batch.column(0).to_numpy(), x.reshape(n, nx), c.reshape(n, nc)


def distances(x: np.ndarray, c: np.ndarray, centre: tuple[np.ndarray, np.ndarray], gamma: float) -> np.ndarray:
    """(rows, centres); centre coordinates in steps, modes as hashes."""
    mx, mc = centre
    d = np.empty((len(x), len(mx)))
    for j in range(len(mx)):
        d[:, j] = (((x - mx[j]) / STEP) ** 2).sum(axis=1) + gamma * (c != mc[j]).sum(axis=1)
    return d


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (h.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((v ^ (v >> np.uint64(32))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _costs(t: DataFrame, seeds: list, nx, nc, gamma) -> dict:
    """(start, candidate) -> (rows nearest to it, their summed distance)."""
    bc = t.sparkSession.sparkContext.broadcast(seeds)

    def run(batches):
        got: dict = {}
        for b in batches:
            if b.num_rows:
                _, x, c = _arrays(b, nx, nc)
                for s, centre in enumerate(bc.value):
                    d = distances(x, c, centre, gamma)
                    j = d.argmin(axis=1)
                    n, cost = np.bincount(j, minlength=d.shape[1]), np.bincount(j, np.rint(d[np.arange(len(j)), j] * STEP), d.shape[1])
                    for i in np.flatnonzero(n):
                        a = got.setdefault((s, int(i)), [0, 0])
                        a[0], a[1] = a[0] + int(n[i]), a[1] + int(cost[i])
        rows = [(s, i, n, v) for (s, i), (n, v) in got.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], ["s", "i", "n", "v"])
    g = t.select("h", "x", "c").mapInArrow(run, "s long, i long, n long, v long").groupBy("s", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return {(r.s, r.i): (r.n, r.v / STEP) for r in g.collect()}


def _seeds(t: DataFrame, k: int, starts: int, seed: int, nx, nc, gamma) -> list:
    """k centres per start."""
    sc = t.sparkSession.sparkContext
    first = t.agg(*[F.min(F.struct(F.xxhash64("h", F.lit(seed + s)), "x", "c")).alias(f"s{s}") for s in range(starts)]).first()
    unpack = lambda r: (np.frombuffer(r.x, np.int64), np.frombuffer(r.c, np.int64))
    chosen = [[unpack(first[f"s{s}"])] for s in range(starts)]
    pile = lambda rows: (np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows]))
    for p in range(PASSES):
        cost = _costs(t, [pile(c) for c in chosen], nx, nc, gamma)
        phi = [sum(v for (q, _), (_, v) in cost.items() if q == s) for s in range(starts)]
        bc = sc.broadcast(([pile(c) for c in chosen], phi))

        def draw(batches, bc=bc, p=p):
            for b in batches:
                if b.num_rows:
                    h, x, c = _arrays(b, nx, nc)
                    for s, (centre, total) in enumerate(zip(*bc.value)):
                        if total > 0:
                            d = distances(x, c, centre, gamma).min(axis=1)
                            at = np.flatnonzero(_uniform(h, (seed + s) * 131 + p + 1) < OVERSAMPLE * k * d / total)
                            if len(at):
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at))], ["s", "x", "c"])
        for r in t.select("h", "x", "c").mapInArrow(draw, "s long, x binary, c binary").distinct().orderBy("s", "x", "c").collect():   # about OVERSAMPLE * k a start
            chosen[r.s].append(unpack(r))
    cost = _costs(t, [pile(c) for c in chosen], nx, nc, gamma)
    out = []
    for s in range(starts):
        x, c = pile(chosen[s])
        weight = np.array([cost.get((s, i), (0, 0))[0] for i in range(len(x))], float)
        rng = np.random.default_rng([seed, s])
        pick = [int(rng.choice(len(x), p=weight / weight.sum()))]
        while len(pick) < k:
            d = distances(x, c, (x[pick], c[pick]), gamma).min(axis=1) * weight
            pick.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else pick[0])
        out.append((x[pick].astype(float), c[pick]))
    return out


def _sums(t: DataFrame, centres: list, nx: int, nc: int, gamma: float):
    """One pass: (start, cluster) -> sums (count, numbers, cost); (start, cluster, column) -> mode."""
    bc = t.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        got: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            _, x, c = _arrays(b, nx, nc)
            for s, centre in enumerate(bc.value):
                d = distances(x, c, centre, gamma)
                j = d.argmin(axis=1)
                cost = np.rint(d[np.arange(len(j)), j] * STEP).astype(np.int64)
                for i in np.unique(j):
                    at = j == i
                    for pos, v in enumerate([int(at.sum()), int(cost[at].sum()), *x[at].sum(axis=0).tolist()]):
                        got[s, int(i), pos, 0] = got.get((s, int(i), pos, 0), 0) + v
                    for q in range(nc):
                        for v, n in zip(*np.unique(c[at, q], return_counts=True)):
                            got[s, int(i), -1 - q, int(v)] = got.get((s, int(i), -1 - q, int(v)), 0) + int(n)
        keys = list(got)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in keys], pa.int64()), pa.array([r[1] for r in keys], pa.int64()), pa.array([r[2] for r in keys], pa.int64()),
                                          pa.array([r[3] for r in keys], pa.int64()), pa.array(list(got.values()), pa.int64())], ["s", "i", "pos", "value", "n"])
    g = t.select("h", "x", "c").mapInArrow(run, "s long, i long, pos long, value long, n long").groupBy("s", "i", "pos", "value").agg(F.sum("n").alias("n"))
    # of the categories only the mode leaves Spark (ties: smallest hash)
    g = g.groupBy("s", "i", "pos").agg(F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("m"))
    return {(r.s, r.i, r.pos): (r.m.n, -r.m.v) for r in g.collect()}


def fit(t: DataFrame, k: int, starts: int, seed: int, nx: int, nc: int, gamma: float, rounds: int = ROUNDS):
    """(centres, cost) of the best start."""
    centres = _seeds(t, k, starts, seed, nx, nc, gamma)
    for r in range(rounds + 1):
        got = _sums(t, centres, nx, nc, gamma)
        costs = [sum(got.get((s, i, 1), (0, 0))[0] for i in range(k)) / STEP for s in range(starts)]
        moved = 0.0
        for s, (mx, mc) in enumerate(centres if r < rounds else []):
            for i in range(k):
                n = got.get((s, i, 0), (0, 0))[0]
                if n:                                     # an empty cluster stays where it is
                    new = np.array([got[s, i, 2 + q][0] / n for q in range(nx)])
                    modes = np.array([got[s, i, -1 - q][1] for q in range(nc)], np.int64)
                    moved = max(moved, float(np.abs(new - mx[i]).max(initial=0.0)) / STEP, float((modes != mc[i]).any()))
                    mx[i], mc[i] = new, modes
        if moved <= TOLERANCE:
            break
    best = min(range(starts), key=lambda s: (costs[s], s))
    return centres[best], costs[best]


def segments(df: DataFrame, key: str, cols: Sequence[str], cats: Sequence[str] = (), k: int = 4, starts: int = 10, seed: int = 42,
             gamma: float = 0.5, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """((key, segment), cost): the best of ``starts`` runs. Empty input: no rows, cost 0."""
    t = _table(df, key, cols, cats)
    nx, nc = len(cols), len(cats)
    out = StructType([t.schema["row"], *StructType.fromDDL("segment int").fields])
    if t.isEmpty():
        return t.sparkSession.createDataFrame([], out).select("row.*", "segment"), 0.0
    centre, cost = fit(t, k, starts, seed, nx, nc, gamma, rounds)
    bc = t.sparkSession.sparkContext.broadcast(centre)

    def assign(batches):
        for b in batches:
            _, x, c = _arrays(pa.RecordBatch.from_arrays(b.columns[1:], ["h", "x", "c"]), nx, nc)
            j = distances(x, c, bc.value, gamma).argmin(axis=1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(j.astype(np.int32))], ["row", "segment"])
    return t.mapInArrow(assign, out).select("row.*", "segment"), float(cost)
