"""Target-distribution importance resampling with weighted median-of-medians selection.

1. Every text becomes counts of hashed features (runs of 1 to 2 words, crc32 modulo
   ``BUCKETS``). The bucket counts of the corpus and of the target texts give an array
   of integer log ratios; a document's weight is the floored mean over its features.
2. A Gumbel number drawn from a hash of the id is added: the largest scores are a draw
   without replacement in proportion to the weights.
3. The exact cutoff among N keys comes by weighted median of medians. Every partition
   gives the median of its remaining keys; the median of these, weighted by the
   remaining sizes, splits the rest so that at least a quarter is discarded. Only
   one row per partition reaches the driver; the rest is written anew when it has
   shrunk to a quarter.
4. Only the winners are sorted, in ranges; ranks are place in the range plus its start.

A key is (score, id, row number): ties go to the smaller id, a missing id last, then
rows that agree in all go in the order of their row numbers, which are written once.
Null and empty texts have no features and weight 0; they are drawn only if
``min_words`` is 0. Empty tables give empty results; an empty target counts as T = 0.
Every row of repeated ids or texts is a row of its own. Columns of ``docs`` are
carried untouched, whatever their names (but for the four results). Words may have any
length; a text stays in the task that reads its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.llm.common import cut, with_fields
from propel.llm.wordhash import ALNUM
from propel.llm.wordspan import blocks, crcs, joined_crcs

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: remaining keys from which on Spark sorts them to find the cutoff
FINISH = 4_096


def _features(col):
    """(rows, words and pairs in one array of buckets, their row) by block of texts."""
    for _, rows, b, at, length, bounds in blocks(col, ALNUM):
        c = crcs(b, at, length)
        row = np.repeat(np.arange(rows), np.diff(bounds))
        pair = joined_crcs(c, length)
        same = row[:-1] == row[1:]
        yield rows, np.diff(bounds), np.concatenate([c, pair[same]]) % BUCKETS, np.concatenate([row, row[:-1][same]])


def _count_batches(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, f, _ in _features(batch.column(0)):
            total += np.bincount(f, minlength=BUCKETS)
    which = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(total[which])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Feature counts by bucket over all texts (BUCKETS numbers)."""
    c = texts.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(_count_batches, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in c.groupBy("bucket").agg(F.sum("n").alias("n")).collect():     # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) by bucket."""
    s, t = corpus.astype(float), target.astype(float)
    up, down = (t + 1) * float(int(corpus.sum()) + BUCKETS), (s + 1) * float(int(target.sum()) + BUCKETS)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weight_batches(bc):
    def run(batches):
        gain = bc.value
        for batch in batches:
            words, n, w = [], [], []
            for rows, nw, f, row in _features(batch.column(2)):
                k = np.bincount(row, minlength=rows)
                order = np.argsort(row, kind="stable")
                run_sum = np.concatenate([[0], np.cumsum(gain[f[order]])])
                end = np.cumsum(k)
                words.append(nw)
                n.append(k)
                w.append((run_sum[end] - run_sum[end - k]) // np.maximum(k, 1))
            cols = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (words, n, w)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2] + [pa.array(c) for c in cols], ["doc", "id", "words", "n", "w"])
    return run


def scores(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, keep: list[str], seed: int) -> DataFrame:
    """(doc, words, n, w, id, score, row), written once; ``doc`` holds the columns ``keep``."""
    spark = docs.sparkSession
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{id_col}`").alias("id"),
                      F.col(f"`{text_col}`").cast("string").alias("t"))
    out = with_fields(src.drop("t").schema, "words long, n long, w long")
    d = src.mapInArrow(_weight_batches(spark.sparkContext.broadcast(gain)), out)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return cut(d.withColumn("score", (F.col("w") + gumbel).cast("long")).withColumn("row", F.monotonically_increasing_id()), "scores")


KEY = ["score", "id", "row"]


def better(lo, orient=True):
    """Rows whose key comes before the key ``lo`` (score descending, id ascending with nulls last, row)."""
    s, i, r = F.lit(lo[0]), F.lit(lo[1]), F.lit(lo[2])
    same_id = F.col("id").eqNullSafe(i)
    before = F.coalesce(F.col("id") < i, F.col("id").isNotNull() if lo[1] is None else F.lit(False))
    first = (F.col("score") > s) | ((F.col("score") == s) & (before | (same_id & (F.col("row") < r))))
    return first if orient else ~(first | ((F.col("score") == s) & same_id & (F.col("row") == r)))


def _medians(batches):
    """One row: the median key of a partition's keys, by numpy selection, and their number."""
    score, row, ids = [], [], []
    for b in batches:
        score.append(b.column(0).to_numpy(zero_copy_only=False))
        row.append(b.column(2).to_numpy(zero_copy_only=False))
        ids.append(b.column(1))
    if not score or not sum(len(s) for s in score):
        return
    s, r, i = np.concatenate(score), np.concatenate(row), pa.concat_arrays(ids)
    m = len(s) // 2
    cut_score = -np.partition(-s, m)[m]
    rest = np.flatnonzero(s == cut_score)
    m -= int((s > cut_score).sum())
    t = pa.table({"i": i.take(pa.array(rest)), "r": pa.array(r[rest])})
    t = t.sort_by([("i", "ascending"), ("r", "ascending")]).slice(m, 1).to_pylist()[0]   # nulls last
    yield pa.RecordBatch.from_arrays([pa.array([int(cut_score)], pa.int64()), pa.array([t["i"]], ids[0].type),
                                      pa.array([int(t["r"])], pa.int64()), pa.array([len(s)], pa.int64())], [*KEY, "n"])


def cutoff(keys: DataFrame, k: int):
    """The key of the k-th best row of ``keys`` (score, id, row), k from 1; None if there are fewer."""
    rest = keys.select(*KEY)
    id_type = rest.schema["id"].dataType.simpleString()
    order = lambda p: (-p[0], p[1] is None, p[1] if p[1] is not None else 0, p[2])
    size = written = rest.count()
    if k < 1 or k > size:
        return None
    while size > FINISH:
        med = rest.mapInArrow(_medians, f"score long, id {id_type}, row long, n long").collect()      # a row per partition
        med = sorted(((tuple(m[:3]), m[3]) for m in med), key=lambda m: order(m[0]))
        half, pivot = size / 2, None
        for pivot, n in med:
            half -= n
            if half <= 0:
                break
        first = rest.where(better(pivot)).count()
        if k == first + 1:
            return pivot
        rest = rest.where(better(pivot, orient=k <= first))
        size, k = (first, k) if k <= first else (size - first - 1, k - first - 1)
        if size * 4 < written:
            rest, written = cut(rest, "rest"), size
    last = rest.orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row").offset(k - 1).limit(1).first()
    return tuple(last)


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` plus ``rank`` (1, 2, ...) in key order, by ranges."""
    n = max(1, winners.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    s = cut(winners.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("at", 33)
    sizes = s.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect()      # a row per range
    start = []
    for r in sizes:
        start.append((r.p, start[-1][1] + start[-1][2] if start else 0, r.c))
    start = s.sparkSession.createDataFrame(start, "p long, begin long, c long").drop("c")
    rank = F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return s.withColumn("p", part).join(F.broadcast(start), "p").withColumn("rank", rank.cast("long")).drop("at", "p", "begin")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             keep: list[str] | None = None, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` (all by default) of every row plus __n_features, __weight, __score and
    __rank (null: not drawn). floor(percent * N / 100) of the N rows with ``min_words`` words are drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    d = scores(docs, gain, id_col, text_col, docs.columns if keep is None else keep, seed)
    may = d.where(F.col("words") >= min_words)
    k = percent * may.count() // 100
    last = cutoff(may, k)
    out = [F.col("doc.*"), F.col("n").alias("__n_features"), F.col("w").alias("__weight"), F.col("score").alias("__score")]
    none = F.lit(None).cast("long").alias("__rank")
    if last is None:
        return d.select(*out, none)
    won = (F.col("words") >= min_words) & ~better(last, orient=False)
    return ranked(d.where(won)).select(*out, F.col("rank").alias("__rank")).unionByName(d.where(~won).select(*out, none))
