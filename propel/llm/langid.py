"""Language ID by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes of 1 to 4 bytes, its byte 2- and 3-grams
with word ends, its identity (all hashed into ``DIM`` numbers) and the language
whose lexicon holds it. Emission weights and the transitions between languages are
learned together: labelled spans of different documents are spliced into code-switched
sequences, and Adam follows the gradient of the log-likelihood, which forward-backward
gives. Every word of a text gets its label probabilities by forward-backward over the
whole text; the prediction is the language with the largest sum of them, the score its
share of all words.

Forward-backward runs over all words of many texts at once: texts are cut into chunks of
``CHUNK`` words, the products of the transition matrices of the chunks carry the
forward and backward vectors over chunk ends, so the result is exact however long a
text is.

The classifier is fit on a bounded sample: at most ``MAX_ROWS`` labelled ids, taken in turn
from all languages in the order of a hash, ``SPANS`` spans of ``SPAN`` words of each. Everything
else covers whole texts. A null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing could be learned. Words are runs of letters a-z (A-Z folded)
and characters beyond ASCII. Of several rows with one id one trains, the smallest spans
first. Every row is predicted by itself, so repeated rows agree. Ties go to the first
language in code-point order. Columns of ``docs`` are carried untouched, whatever
their names (but for the results). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propel.llm.common import with_fields
from propel.llm.wordhash import splitmix
from propel.llm.wordspan import blocks, flat, hashes

DIM, CHUNK = 1 << 16, 64
MAX_ROWS, SPANS, SPAN = 1200, 4, 32
EPOCHS, RATE, DECAY, SEED = 40, 0.08, 1e-5, 11


def letters_table() -> np.ndarray:
    """Byte -> folded byte + 1, 0 for what is no letter; bytes beyond ASCII belong to words."""
    t = np.zeros(256, np.uint16)
    t[97:123] = np.arange(97, 123) + 1
    t[65:91] = np.arange(97, 123) + 1
    t[128:] = np.arange(128, 256) + 1
    return t


LETTERS = letters_table()


def word_features(b: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of all hashed features of the words at ``at`` in the folded bytes ``b``."""
    n = len(at)
    places, begin = flat(at, length)
    own = np.arange(n)
    first = begin[:-1] + 2 * own
    sym = np.zeros(int(begin[-1]) + 2 * n, np.uint64)
    sym[first], sym[first + length + 1] = 1, 2                       # word ends
    sym[np.arange(begin[-1]) + 2 * np.repeat(own, length) + 1] = b[places]
    word = np.repeat(own, length + 2)
    out, of = [], []

    def add(code, tag, which):
        out.append((splitmix(code + (np.uint64(tag) << np.uint64(56))) & np.uint64(DIM - 1)).astype(np.int32))
        of.append(which)
    for k in (2, 3):
        m = max(len(sym) - k + 1, 0)
        code = np.zeros(m, np.uint64)
        for j in range(k):
            code = code * np.uint64(256) + sym[j:j + m]
        inside = word[:m] == word[k - 1:]
        add(code[inside], k, word[:m][inside])
    for k in (1, 2, 3, 4):
        long = own[length >= k]
        head, tail = np.zeros(len(long), np.uint64), np.zeros(len(long), np.uint64)
        for j in range(k):
            head = head * np.uint64(256) + b[at[long] + j]
            tail = tail * np.uint64(256) + b[at[long] + length[long] - k + j]
        add(head, 8 + k, long)
        add(tail, 16 + k, long)
    add(hashes(b, at, length) >> np.uint64(8), 24, own)
    return np.concatenate(out), np.concatenate(of)


def emissions(model: dict, b, at, length) -> np.ndarray:
    """(words, languages) summed weights of the words' features."""
    f, w = word_features(b, at, length)
    e = np.stack([np.bincount(w, x[f], len(at)) for x in model["weights"].T[:, :DIM]], axis=1) if len(at) else np.zeros((0, len(model["langs"])))
    return e + model["weights"][DIM + lexicon(model, hashes(b, at, length))]


def lexicon(model: dict, h: np.ndarray) -> np.ndarray:
    """The language whose lexicon holds a word; the number of languages for none."""
    known, lang = model["words"], model["word_lang"]
    if not len(known) or not len(h):
        return np.full(len(h), len(model["langs"]))
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, lang[at], len(model["langs"]))


def forward_backward(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray):
    """(label probabilities of every word, expected transitions) of sequences ``bounds`` over
    emissions ``e``; before the first word all languages are alike."""
    n, k = e.shape
    size = np.diff(bounds)
    pieces = -(-size // CHUNK)
    base = np.concatenate([[0], np.cumsum(pieces)])
    seq = np.repeat(np.arange(len(size)), size)
    pos = np.arange(n) - bounds[:-1][seq]
    chunk, slot = base[seq] + pos // CHUNK, pos % CHUNK
    c = int(base[-1])
    length = np.bincount(chunk, minlength=c)
    order = np.argsort(-length, kind="stable")                       # chunks by length, so the open ones are a prefix
    place = np.empty(c, np.int64)
    place[order] = np.arange(c)
    open_ = [int(x) for x in np.searchsorted(-length[order], -np.arange(CHUNK), side="left")]
    psi = np.ones((c, CHUNK, k))
    psi[place[chunk], slot] = np.exp(e - e.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max())
    prod = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    for t in range(CHUNK if len(pieces) and pieces.max() > 1 else 0):
        m = open_[t]
        prod[:m] = (prod[:m] @ a) * psi[:m, t, None, :]
        prod[:m] /= prod[:m].sum(axis=(1, 2), keepdims=True)
    come, go = np.full((c, k), 1.0 / k), np.full((c, k), 1.0 / k)
    by = np.argsort(-pieces, kind="stable")
    for i in range(1, int(pieces.max()) if len(pieces) else 0):
        s = by[:int((pieces > i).sum())]
        v = np.einsum("nk,nkj->nj", come[place[base[s] + i - 1]], prod[place[base[s] + i - 1]])
        come[place[base[s] + i]] = v / v.sum(axis=1, keepdims=True)
        last = base[s + 1] - i
        v = np.einsum("nkj,nj->nk", prod[place[last]], go[place[last]])
        go[place[last - 1]] = v / v.sum(axis=1, keepdims=True)
    alpha, beta = np.zeros((c, CHUNK, k)), np.zeros((c, CHUNK, k))
    v = come.copy()
    for t in range(CHUNK):
        m = open_[t]
        v[:m] = (v[:m] @ a) * psi[:m, t]
        v[:m] /= v[:m].sum(axis=1, keepdims=True)
        alpha[:m, t] = v[:m]
    v = go.copy()
    for t in range(CHUNK - 1, -1, -1):
        m = open_[t]
        beta[:m, t] = v[:m]
        v[:m] = (psi[:m, t] * v[:m]) @ a.T
        v[:m] /= v[:m].sum(axis=1, keepdims=True)
    at = place[chunk], slot
    al, be = alpha[at], beta[at]
    gamma = al * be
    gamma /= gamma.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(pos > 0)                                  # pairs of neighbours in one sequence
    right = psi[at][inner] * be[inner]
    norm = np.einsum("ni,ij,nj->n", al[inner - 1], a, right)
    pairs = np.einsum("ni,ij,nj->ij", al[inner - 1] / norm[:, None], a, right)
    return gamma, pairs


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Model from (language, span) rows; the words of a span are separated by spaces."""
    sample = sorted(x for x in sample if x[1])
    langs = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(seed)
    sample = [sample[i] for i in rng.permutation(len(sample))]       # neighbours become one code-switched text
    k = len(langs)
    model = {"langs": langs, "words": np.zeros(0, np.uint64), "word_lang": np.zeros(0, np.int64),
             "weights": np.zeros((DIM + k + 1, k)), "trans": np.zeros((k, k))}
    if not sample:
        return model
    lang = np.array([langs.index(x) for x, _ in sample])
    _, _, b, at, length, bounds = next(_one_block(sample))
    y = np.repeat(lang, np.diff(bounds))
    h = hashes(b, at, length)
    known, first, which = np.unique(h, return_index=True, return_inverse=True)
    # lexicons: words of the first half of the spans, at least two thirds of them in one language
    half = np.repeat(np.arange(len(sample)) % 2 == 0, np.diff(bounds))
    seen = np.stack([np.bincount(which[half & (y == j)], minlength=len(known)) for j in range(k)], axis=1)
    firm = (seen.max(axis=1) >= 2) & (3 * seen.max(axis=1) >= 2 * seen.sum(axis=1))
    model["words"], model["word_lang"] = known[firm], seen.argmax(axis=1)[firm]
    f, w = word_features(b, at[first], length[first])
    f, w = np.concatenate([f, DIM + lexicon(model, known)]), np.concatenate([w, np.arange(len(known))])
    joined = bounds[::SPANS] if (len(bounds) - 1) % SPANS == 0 else np.append(bounds[:-1:SPANS], bounds[-1])
    joined = joined[np.concatenate([[True], np.diff(joined) > 0])]
    aim = np.eye(k)[y]
    inner = np.ones(len(y), bool)
    inner[joined[:-1]] = False
    inner = np.flatnonzero(inner)
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (y[inner - 1], y[inner]), 1)
    params = [model["weights"], model["trans"]]
    first_m, second_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        e = np.stack([np.bincount(w, params[0][f, j], len(known)) for j in range(k)], axis=1)[which]
        gamma, pairs = forward_backward(e, joined, params[1])
        off = np.stack([np.bincount(which, (gamma - aim)[:, j], len(known)) for j in range(k)], axis=1)
        grads = [np.stack([np.bincount(f, off[w, j], len(params[0])) for j in range(k)], axis=1) / len(y) + DECAY * params[0],
                 (pairs - true_pairs) / len(y) + DECAY * params[1]]
        for p, g, m, s in zip(params, grads, first_m, second_m):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return model


def _one_block(sample):
    """The sample as one block of texts (bounded by MAX_ROWS * SPANS * SPAN words)."""
    parts = list(blocks(pa.array([t for _, t in sample]), LETTERS))
    shift_b = np.cumsum([0] + [len(p[2]) for p in parts])
    shift_w = np.cumsum([0] + [len(p[3]) for p in parts])
    yield (0, len(sample), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] + s for p, s in zip(parts, shift_b)]),
           np.concatenate([p[4] for p in parts]), np.concatenate([[0]] + [p[5][1:] + s for p, s in zip(parts, shift_w)]))


def _span_batches(batches):
    """(id, lang, spans): SPANS spans of SPAN words, evenly spread over the whole text."""
    for batch in batches:
        out = []
        for _, rows, b, at, length, bounds in blocks(batch.column(2), LETTERS):
            for i in range(rows):
                lo, n = bounds[i], bounds[i + 1] - bounds[i]
                starts = [j * max(n - SPAN, 0) // max(SPANS - 1, 1) for j in range(SPANS if n > SPAN else 1)] if n else []
                out.append([b" ".join(b[at[q]:at[q] + length[q]].tobytes()[:64] for q in range(lo + s, lo + min(s + SPAN, n))).decode("utf-8", "ignore")
                            for s in starts])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.string()))], ["id", "lang", "spans"])


def sample_spans(docs: DataFrame, learn, id_col="doc_id", text_col="text", lang_col="lang", max_rows: int = MAX_ROWS) -> list[tuple[str, str]]:
    """(language, span) rows of at most ``max_rows`` labelled ids where ``learn`` holds. The ids
    are chosen before any text is read."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                      F.col(f"`{text_col}`").cast("string").alias("t"), learn.alias("learn"))
    own = own.where("learn AND id IS NOT NULL AND lang IS NOT NULL AND t IS NOT NULL").drop("learn")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    some = own.select("id", "lang").withColumn("turn", turn).where(F.col("turn") <= max_rows)
    some = some.orderBy("turn", "lang").limit(max_rows).select("id", "lang").distinct()
    rows = own.join(F.broadcast(some), ["id", "lang"]).select("id", "lang", "t")          # max_rows ids
    spans = rows.mapInArrow(_span_batches, with_fields(rows.drop("t").schema, "spans array<string>"))
    got = spans.groupBy("id", "lang").agg(F.min("spans").alias("spans")).select("lang", F.explode("spans").alias("span")).toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))               # at most max_rows * SPANS spans


def fit(docs: DataFrame, learn, id_col="doc_id", text_col="text", lang_col="lang", max_rows: int = MAX_ROWS) -> dict:
    """Model from the rows of ``docs`` where the condition ``learn`` holds and the language is known."""
    return train(sample_spans(docs, learn, id_col, text_col, lang_col, max_rows))


def _predict_batches(bc):
    def run(batches):
        model = bc.value
        langs, k = model["langs"], len(model["langs"])
        for batch in batches:
            pred, score, n_words, runs = [], [], [], []
            for row, rows, b, at, length, bounds in blocks(batch.column(1), LETTERS):
                _, first, which = np.unique(hashes(b, at, length), return_index=True, return_inverse=True)
                share, best = np.zeros((rows, k)), np.zeros(0, np.int64)
                if len(at) and k:
                    full = np.unique(bounds)                        # rows without words are no sequences
                    gamma, _ = forward_backward(emissions(model, b, at[first], length[first])[which], full, model["trans"])
                    best = gamma.argmax(axis=1)
                    which_row = np.repeat(np.arange(rows), np.diff(bounds))
                    share = np.stack([np.bincount(which_row, gamma[:, j], rows) for j in range(k)], axis=1)
                for i in range(rows):
                    n = int(bounds[i + 1] - bounds[i])
                    own = best[bounds[i]:bounds[i + 1]] if len(best) else best
                    start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.zeros(0, np.int64)
                    sure = n > 0 and k > 0 and (length_has_ascii(b, at, bounds[i], bounds[i + 1])
                                                or any(c.isalpha() for c in batch.column(1)[row + i].as_py()))
                    j = int(share[i].argmax()) if sure else 0
                    pred.append(langs[j] if sure else "und")
                    score.append(min(float(share[i, j]) / n, 1.0) if sure else 0.0)
                    n_words.append(n)
                    runs.append([{"lang": langs[own[s]], "start": int(s), "words": int(t - s)}
                                 for s, t in zip(start, np.append(start[1:], n))] if sure else [])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(n_words, pa.int64()), pa.array(runs, kind)], ["doc", "lang_pred", "score", "n_words", "runs"])
    return run


def length_has_ascii(b, at, lo, hi) -> bool:
    """Whether a word of the row starts with an ASCII letter (a quick proof that it has a letter)."""
    return bool((b[at[lo:hi]] < 128).any())


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row plus __lang_pred, __score, __n_words and
    __runs (spans of words with one language, in order)."""
    bc = docs.sparkSession.sparkContext.broadcast(model)            # DIM x languages weights and the lexicons
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("doc"),
                      F.col(f"`{text_col}`").cast("string").alias("t"))
    out = with_fields(src.select("doc").schema, "lang_pred string, score double, n_words long, runs array<struct<lang: string, start: long, words: long>>")
    d = src.mapInArrow(_predict_batches(bc), out)
    return d.select("doc.*", *[F.col(c).alias(f"__{c}") for c in ("lang_pred", "score", "n_words", "runs")])
