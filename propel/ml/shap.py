"""Exact path-dependent Shapley values of boosted trees.

Each leaf is a path: per feature on it, the range of bins that reaches the leaf and the
share of the training weight that does (the product of the shares of its splits). A
feature inside its range counts 1, one left out of a coalition counts its share. With
m features on a path, the weights |S|! (m - |S| - 1)! / m! come from the coefficients of the
polynomial prod(share + inside * t) of the other features, built once per pattern of
features inside (a path of m features has 2^m); a row looks its pattern up. Contributions add up to
the margin less the base value (the mean margin over the training weight).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from propel.ml import boosting as gb

#: features of a path up to which all its patterns are worked out before the rows
TABLE_FEATURES = 8


def leaf_paths(tree: gb.Tree) -> list:
    """(value, share of the weight, features, first bins, last bins, shares) per leaf."""
    out = []

    def walk(node, spans, share):
        f = tree.feature[node]
        if f < 0:
            fs = sorted(spans)
            out.append((tree.value[node], share, np.array(fs, np.int64), np.array([spans[x][0] for x in fs], np.int64),
                        np.array([spans[x][1] for x in fs], np.int64), np.array([spans[x][2] for x in fs])))
            return
        for child, keep in ((tree.left[node], (0, tree.cut[node])), (tree.right[node], (tree.cut[node] + 1, 1 << 30))):
            r = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.5
            lo, hi, p = spans.get(f, (0, 1 << 30, 1.0))
            walk(child, {**spans, f: (max(lo, keep[0]), min(hi, keep[1]), p * r)}, share * r)
    walk(0, {}, 1.0)
    return out


def weights(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Contribution of every feature of a path with leaf value 1, by pattern ``inside`` (patterns, m)."""
    n, m = inside.shape
    out = np.zeros((n, m))
    w = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
    for j in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        for i in range(m):
            if i != j:
                up = np.zeros_like(poly)
                up[:, 1:] = poly[:, :-1] * inside[:, i:i + 1]
                poly = poly * share[i] + up
        out[:, j] = (inside[:, j] - share[j]) * (poly @ w)
    return out


def base_value(model: gb.Model) -> float:
    return model.base + sum(v * s for t in model.trees for v, s, *_ in leaf_paths(t))


def tables(paths: list) -> list:
    """Per path the contributions by pattern of features inside, (features, patterns); None for a path of many features."""
    out = []
    for value, _, fs, _, _, share in paths:
        m = len(fs)
        every = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float) if 0 < m <= TABLE_FEATURES else None
        out.append(None if every is None else np.ascontiguousarray((value * weights(every, share)).T))
    return out


def contributions(paths: list, bins: np.ndarray, n_features: int, known: list | None = None) -> np.ndarray:
    """(rows, features) over all leaves; ``known``: the paths' :func:`tables`."""
    cols = np.ascontiguousarray(bins.T, np.uint8)
    out = np.zeros((n_features, len(bins)))
    for (value, _, fs, lo, hi, share), table in zip(paths, known or tables(paths)):
        if not len(fs) or not len(bins):
            continue
        if table is None:
            inside = (bins[:, fs] >= lo) & (bins[:, fs] <= hi)
            seen, which = np.unique(inside, axis=0, return_inverse=True)
            out[fs] += (value * weights(seen.astype(float), share))[which.ravel()].T
            continue
        code = np.zeros(len(bins), np.uint8)
        for j, f in enumerate(fs):
            inside = cols[f] <= np.uint8(min(hi[j], 255))
            if lo[j]:
                inside &= cols[f] >= np.uint8(lo[j])
            code |= inside.view(np.uint8) << np.uint8(j)
        at = code.astype(np.intp)
        for j, f in enumerate(fs):
            out[f] += table[j].take(at)
    return np.ascontiguousarray(out.T)


def attributions(df: DataFrame, model: gb.Model, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of every row plus base, margin and contributions (array of feature, value)."""
    every = [p for t in model.trees for p in leaf_paths(t)]
    bc = df.sparkSession.sparkContext.broadcast((model, every, tables(every), base_value(model)))
    names = model.features

    def run(batches):
        m, paths, known, base = bc.value
        for b in batches:
            bins = gb.bin_matrix([gb._numbers(c) for c in b.columns[1:]], m.edges)
            phi = contributions(paths, bins, len(names), known)
            items = pa.StructArray.from_arrays([pa.array(np.tile(np.array(names, object), len(bins)), pa.string()), pa.array(phi.ravel())], ["feature", "value"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * len(names), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(bins), base)), pa.array(m.margins(bins)), lists], ["row", "base", "margin", "contributions"])
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    out = StructType([src.schema["row"], *StructType.fromDDL("base double, margin double, contributions array<struct<feature: string, value: double>>").fields])
    return src.mapInArrow(run, out).select("row.*", "base", "margin", "contributions")
