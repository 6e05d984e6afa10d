"""Benchmark decontamination by SimHash windows.

Every window of a text with the size of a benchmark item gets a 64-bit SimHash of its
words. Four 16-bit blocks of a multi-index, each searched within a quarter of the
radius, reach all item fingerprints within ``RADIUS`` bits; exact weighted-shingle
similarity (five words, weighted by count) then verifies. Windows in which too few
shingles belong to any item to reach the similarity are skipped before they are
fingerprinted (a necessary condition, so no match is lost). Items are taken in blocks of
bounded size. Null and empty texts and items match nothing; an item of fewer than five
words must stand as the same words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.llm.wordhash import ALNUM, combine, iter_words, shingles

K, RADIUS, ITEM_BLOCK, PIECE = 5, 15, 20_000, 1 << 15


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8)).reshape(-1, 64).astype(np.int8) * 2 - 1


def _pack(x: np.ndarray) -> np.ndarray:
    return np.packbits(x > 0, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class Members:
    """Membership of hashes in a fixed set; a bit table turns most of them away."""

    def __init__(self, parts: list[np.ndarray]):
        self.values = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.mask = np.uint64((1 << min(24, max(16, (16 * len(self.values)).bit_length()))) - 1)
        self.gate = np.zeros(int(self.mask) + 1, bool)
        self.gate[self.values & self.mask] = True

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Members among the first i of ``x``, for i from 0 to len(x)."""
        out = np.zeros(len(x) + 1, np.int64)
        maybe = np.flatnonzero(self.gate[x & self.mask])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
            out[1 + maybe[self.values[at] == x[maybe]]] = 1
        return np.cumsum(out)


class Index:
    """Item fingerprints by length, with block tables that cover the radius."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float):
        self.similarity, self.by_len = similarity, {}
        self.grams = Members([combine(h, K) for _, h in items if len(h) >= K])
        self.words = Members([h for _, h in items if len(h) < K])  # short items match word by word
        near = [0] + [sum(1 << b for b in c) for r in range(1, RADIUS // 4 + 1) for c in combinations(range(16), r)]
        near = np.array(near, np.uint16)
        for n in sorted({len(h) for _, h in items}):
            own = [(i, h) for i, h in items if len(h) == n]
            prints = _pack(np.array([_bits(h).sum(0, dtype=np.int32) for _, h in own]))
            tables = np.zeros((4, 1 << 16), bool)
            for b, block in enumerate(prints.view(np.uint16).reshape(-1, 4).T):
                tables[b, (block[:, None] ^ near[None, :]).ravel()] = True
            need = n if n < K else int(np.ceil((n - K + 1) * 2 * similarity / (1 + similarity) - 1e-9))
            self.by_len[n] = ([i for i, _ in own], prints, tables, need,
                              [np.unique(shingles(h, K), return_counts=True) for _, h in own])

    def _similar(self, grams, h: np.ndarray) -> float:
        g, c = np.unique(shingles(h, K), return_counts=True)
        both, x, y = np.intersect1d(grams[0], g, assume_unique=True, return_indices=True)
        least = np.minimum(grams[1][x], c[y]).sum()
        return least / (grams[1].sum() + c.sum() - least)

    def possible(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per text (words bounds[i] to bounds[i + 1] of ``h``): whether any shingle or word of an item is in it."""
        grams, words = self.grams.counts(combine(h, K)), self.words.counts(h)
        lo = np.minimum(bounds[:-1], len(grams) - 1)
        hi = np.clip(bounds[1:] - K + 1, lo, len(grams) - 1)
        return (grams[hi] > grams[lo]) | (words[bounds[1:]] > words[bounds[:-1]])

    def search(self, h: np.ndarray):
        """Best (item, start, words, similarity) per item over the words of one text."""
        best: dict = {}
        if not len(h) or not self.by_len:
            return []
        longest = max(self.by_len)
        by_gram, by_word = self.grams.counts(combine(h, K)), self.words.counts(h)
        for lo in range(0, len(h), PIECE):
            part = h[lo:lo + PIECE + longest - 1]
            sums = None
            for n, (ids, prints, tables, need, grams) in self.by_len.items():
                m = min(len(part) - n + 1, PIECE)
                if m <= 0:
                    continue
                known, w = (by_word, n) if n < K else (by_gram, n - K + 1)
                start = np.flatnonzero(known[lo + w:lo + w + m] - known[lo:lo + m] >= need)
                if not len(start):
                    continue
                if sums is None:
                    sums = np.zeros((len(part) + 1, 64), np.int32)
                    np.cumsum(_bits(part), axis=0, dtype=np.int32, out=sums[1:])
                for s0 in range(0, len(start), 8192):
                    st = start[s0:s0 + 8192]
                    fp = _pack(sums[st + n] - sums[st])
                    b4 = fp.view(np.uint16).reshape(-1, 4)
                    hit = tables[0][b4[:, 0]] | tables[1][b4[:, 1]] | tables[2][b4[:, 2]] | tables[3][b4[:, 3]]
                    for j in np.flatnonzero(hit):
                        d = np.bitwise_count(prints ^ fp[j])
                        for q in np.flatnonzero(d <= RADIUS):
                            s = self._similar(grams[q], part[st[j]:st[j] + n])
                            if s >= self.similarity and s > best.get(ids[q], (0, 0, -1.0))[2]:
                                best[ids[q]] = (lo + int(st[j]), n, s)
        return [(i, *v) for i, v in best.items()]


def item_indexes(benchmark: DataFrame, similarity: float, id_col="item_id", text_col="text"):
    """Indexes over blocks of at most ITEM_BLOCK items (the benchmark is streamed, never held whole)."""
    rows, block = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(f"{text_col} IS NOT NULL"), []
    for r in rows.toLocalIterator():
        for _, _, h, _ in iter_words(pa.array([r[1]]), ALNUM):
            if len(h):
                block.append((r[0], h))
        if len(block) == ITEM_BLOCK:
            yield Index(block, similarity)
            block = []
    if block:
        yield Index(block, similarity)


def _rows(bc, matches: bool):
    def run(batches):
        index = bc.value
        for b in batches:
            ids, hits, keep = b.column(0), [], []
            for first, rows, h, bd in iter_words(b.column(1), ALNUM):
                some = index.possible(h, bd)
                for i in range(rows):
                    got = index.search(h[bd[i]:bd[i + 1]]) if some[i] else []
                    keep.append(not got)
                    hits += [(ids[first + i].as_py(), *x) for x in got]
            if matches:
                cols = list(zip(*hits)) if hits else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                    ["id", "item_id", "start_word", "n_words", "similarity"])
            else:
                kept = b.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[2:], kept.schema.names[2:])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", similarity: float = 0.8) -> DataFrame:
    """(id, item_id, start_word, n_words, similarity): best window of each item in each text."""
    sc, out = docs.sparkSession.sparkContext, None
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    for index in item_indexes(benchmark, similarity):
        got = src.mapInArrow(_rows(sc.broadcast(index), True), "id long, item_id long, start_word long, n_words long, similarity double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = src.limit(0).selectExpr("id", "id item_id", "id start_word", "id n_words", "cast(0 AS double) similarity")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col="text", similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` in which no item is found."""
    sc = docs.sparkSession.sparkContext
    schema = docs.schema
    for index in item_indexes(benchmark, similarity):
        src = docs.select(F.lit(0).cast("long").alias("__i"), F.col(f"`{text_col}`").alias("__t"), *[F.col(f"`{c}`") for c in docs.columns])
        docs = src.mapInArrow(_rows(sc.broadcast(index), False), schema)
    return docs
