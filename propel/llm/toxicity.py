"""Toxicity by non-negative positive-unlabelled (PU) learning.

A linear numpy classifier over hashed words is trained from confirmed toxic rows and an
unlabelled sample of all documents, whose labels are never looked at. It minimises
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the logistic loss; while the bracket
is negative its gradient is climbed instead. All weights start at zero. A first pass
carries an L1 penalty on the scale of each word's own sampling noise, so the risk
chooses the words; a second pass fits the chosen words without penalty.

The class prior ``pi`` is a parameter or is estimated: for every threshold the share of
unlabelled rows above it is at least ``pi`` times the share of confirmed rows, so the
least ratio on rows that were kept out of the fit bounds it (``PRIOR`` where fewer than
``ENOUGH`` rows are confirmed).

The fit reads a bounded sample: at most ``MAX_ROWS`` ids (a fifth of them confirmed, the
others from all documents), smallest hash first, chosen before any text is read; one task trains on
their word sets (at most 2**BITS numbers each), and only the weights reach the driver.
Every text is scored whole. Null and empty texts have no words and get the bias
alone. Rows without id, and without label, train nothing. An id with several labels
is confirmed if one says so; of several rows with one id, the one with the smallest
word set trains, and each is scored by itself. Without a confirmed row all scores are
those of a bias of -5. Empty tables give empty results. Columns of ``docs`` are
carried untouched, whatever their names (but for ``__score``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.llm.common import with_fields
from propel.llm.wordhash import ALNUM, iter_words

BITS, MAX_ROWS = 18, 20_000
EPOCHS, REFIT, RATE, PENALTY, LEAST_DF = 40, 60, 0.1, 2.0, 3
#: class prior at the start, and where fewer than ENOUGH confirmed rows leave too few to estimate it
PRIOR, ENOUGH = 0.1, 40


def _features(h: np.ndarray) -> np.ndarray:
    return np.unique(h >> np.uint64(64 - BITS)).astype(np.int32)


def _word_sets(batches):
    for b in batches:
        out = [_features(h[bd[i]:bd[i + 1]]).tobytes() for _, rows, h, bd in iter_words(b.column(0), ALNUM) for i in range(rows)]
        yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(out, pa.binary())], [*b.schema.names[1:], "f"])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, confirmed, unlabelled, f) from the learning folds: crc32(doc_id as text) mod 5
    is not 0. ``f`` holds the hashed words of the text. A row may serve as both kinds."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    kind = lambda c, u: [F.lit(c).alias("confirmed"), F.lit(u).alias("unlabelled")]
    con = labels.where(fold & (F.col("toxic") == 1)).select("doc_id").distinct().orderBy(*order).limit(max_rows // 5)
    unl = docs.where(fold).select("doc_id").distinct().orderBy(*order).limit(max_rows - max_rows // 5)
    ids = con.select("doc_id", *kind(1, 0)).unionByName(unl.select("doc_id", *kind(0, 1)))
    ids = ids.groupBy("doc_id").agg(F.max("confirmed").alias("confirmed"), F.max("unlabelled").alias("unlabelled"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")   # the bounded sample
    rows = rows.select("text", "doc_id", "confirmed", "unlabelled")
    sets = rows.mapInArrow(_word_sets, with_fields(rows.drop("text").schema, "f binary"))
    return sets.groupBy("doc_id", "confirmed", "unlabelled").agg(F.min("f").alias("f"))


class Sample:
    """Confirmed and unlabelled rows as one array of (row, word) entries."""

    def __init__(self, confirmed: list[np.ndarray], unlabelled: list[np.ndarray]):
        both = [*confirmed, *unlabelled]
        self.n_c, self.n_u = len(confirmed), len(unlabelled)
        size = [len(f) for f in both]
        self.row = np.repeat(np.arange(len(both)), size)
        self.word = np.concatenate(both) if sum(size) else np.zeros(0, np.int64)

    def to(self, kept: np.ndarray, dim: int) -> "Sample":
        """Only the words ``kept``, renumbered."""
        at = np.full(dim, -1)
        at[kept] = np.arange(len(kept))
        out = Sample([], [])
        out.n_c, out.n_u = self.n_c, self.n_u
        inside = at[self.word] >= 0
        out.row, out.word = self.row[inside], at[self.word[inside]]
        return out

    def margins(self, w: np.ndarray) -> np.ndarray:
        """w's last number is the bias."""
        return np.bincount(self.row, w[self.word], self.n_c + self.n_u) + w[-1]


def risk(s: Sample, w: np.ndarray, pi: float) -> tuple[float, float]:
    """(pi R_p(+), R_u(-) - pi R_p(-)): the second is cut at 0 in the risk."""
    z = s.margins(w)
    return pi * np.logaddexp(0, -z[:s.n_c]).mean(), np.logaddexp(0, z[s.n_c:]).mean() - pi * np.logaddexp(0, z[:s.n_c]).mean()


def gradient(s: Sample, w: np.ndarray, pi: float) -> tuple[np.ndarray, bool]:
    """Gradient of the risk, or of minus its bracket where that is negative (True)."""
    z = s.margins(w)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    below = risk(s, w, pi)[1] < 0
    c, u = slice(0, s.n_c), slice(s.n_c, None)
    d = np.empty(len(z))
    if below:
        d[c], d[u] = pi * p[c] / s.n_c, -p[u] / s.n_u
    else:
        d[c], d[u] = pi * (p[c] - 1) / s.n_c - pi * p[c] / s.n_c, p[u] / s.n_u
    return np.append(np.bincount(s.word, d[s.row], len(w) - 1), d.sum()), below


def descend(s: Sample, w: np.ndarray, pi: float, epochs: int, penalty, state=None):
    """Adam steps on the risk, each followed by soft thresholds of ``penalty`` on the words."""
    m, v, t0 = state or (np.zeros_like(w), np.zeros_like(w), 0)
    for t in range(t0 + 1, t0 + epochs + 1):
        g, _ = gradient(s, w, pi)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        scale = RATE / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w = w - scale * m / (1 - 0.9 ** t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - scale[:-1] * penalty, 0)
    return w, (m, v, t0 + epochs)


def learn(confirmed: list, unlabelled: list, pi: float, epochs: int = EPOCHS, refit: int = REFIT) -> np.ndarray:
    """2**BITS word weights and the bias."""
    dim = 1 << BITS
    full = Sample(confirmed, unlabelled)
    df = np.bincount(full.word, minlength=dim)
    kept = np.flatnonzero(df >= LEAST_DF)
    s = full.to(kept, dim)
    share = (np.bincount(s.word[s.row >= s.n_c], minlength=len(kept)) + 1) / (s.n_u + 1)
    noise = 0.5 * np.sqrt(share * (pi * pi / s.n_c + 1 / s.n_u))        # of a word's gradient at zero weights
    w, (m, v, t) = descend(s, np.zeros(len(kept) + 1), pi, epochs, PENALTY * noise)
    chosen = np.flatnonzero(w[:-1])
    part = np.append(chosen, len(kept))
    w, _ = descend(s.to(chosen, len(kept)), w[part], pi, refit, 0.0, (m[part], v[part], t))
    out = np.zeros(dim + 1)
    out[kept[chosen]], out[-1] = w[:-1], w[-1]
    return out


def prior(confirmed: np.ndarray, unlabelled: np.ndarray, least: float = 0.25) -> float:
    """Bound of the class prior from margins of rows outside the fit: the least ratio of the
    shares above a threshold that ``least`` of the confirmed rows pass, a deviation added."""
    ts = np.unique(np.quantile(confirmed, np.linspace(0, 1 - least, 60)))
    c = (confirmed[None, :] >= ts[:, None]).mean(axis=1)
    u = (unlabelled[None, :] >= ts[:, None]).mean(axis=1)
    return float(np.clip(((u + np.sqrt(u * (1 - u) / len(unlabelled))) / c).min(), 1e-3, 0.5))


def train(confirmed: list, unlabelled: list, pi: float | None = None) -> tuple[np.ndarray, float]:
    """(weights, class prior); rows come in a fixed order."""
    if not confirmed or not unlabelled:
        return np.append(np.zeros(1 << BITS), -5.0), 0.0
    if pi is None:
        pi = PRIOR
        if len(confirmed) >= ENOUGH:
            for _ in range(2):              # every fourth row is kept out
                w = learn([f for i, f in enumerate(confirmed) if i % 4], [f for i, f in enumerate(unlabelled) if i % 4], pi, EPOCHS, REFIT // 3)
                held = Sample(confirmed[::4], unlabelled[::4])
                z = held.margins(w)
                pi = prior(z[:held.n_c], z[held.n_c:])
    return learn(confirmed, unlabelled, pi), pi


def _train_batches(pi):
    def run(batches):
        confirmed, unlabelled = [], []
        for b in batches:
            for c, u, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = np.frombuffer(f.as_py(), np.int32)
                if c:
                    confirmed.append(words)
                if u:
                    unlabelled.append(words)
        by = lambda f: (len(f), f.tobytes())
        w, p = train(sorted(confirmed, key=by), sorted(unlabelled, key=by), pi)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([p])], ["w", "prior"])
    return run


def fit(rows: DataFrame, pi: float | None = None) -> np.ndarray:
    """Weights (bias last) from :func:`training_rows`; ``pi``: class prior, estimated if None."""
    one = rows.select("confirmed", "unlabelled", "f").repartition(1)     # the bounded sample
    return np.frombuffer(one.mapInArrow(_train_batches(pi), "w binary, prior double").first().w, np.float64)


def _score_batches(weights):
    def run(batches):
        w = weights.value
        for b in batches:
            out = []
            for _, rows, h, bd in iter_words(b.column(1), ALNUM):
                for i in range(rows):
                    z = w[_features(h[bd[i]:bd[i + 1]])].sum() + w[-1]
                    out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc", "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) of every row plus ``__score`` (0 to 1)."""
    bc = docs.sparkSession.sparkContext.broadcast(weights)               # 2**BITS doubles
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("doc"),
                      F.col(f"`{text_col}`").cast("string").alias("t"))
    d = src.mapInArrow(_score_batches(bc), with_fields(src.drop("t").schema, "score double"))
    return d.select("doc.*", F.col("score").alias("__score"))
