"""Vectorised 64-bit word and shingle hashes over Arrow text columns.

One pass of numpy over the UTF-8 bytes of many rows at a time; no Python object
per word. Two different words share a hash with probability of about 2**-57.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: bytes of text that one numpy pass works on (its temporaries take about 40 times that)
BLOCK_BYTES = 1 << 21


def splitmix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_MULT = splitmix(np.arange(256, dtype=np.uint64)) | _U(1)


def _multipliers(n: int) -> np.ndarray:
    return _MULT if n <= len(_MULT) else splitmix(np.arange(n, dtype=np.uint64)) | _U(1)


def white_table() -> np.ndarray:
    """Byte -> folded byte + 1, 0 for a separator: words are ``[^\\x20\\x09-\\x0D]+``, A-Z folded."""
    t = np.arange(256, dtype=np.uint16) + 1
    t[65:91] += 32
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


def alnum_table() -> np.ndarray:
    """As :func:`white_table` for ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding A-Z."""
    t = white_table()
    for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        t[lo:hi + 1] = 0
    return t


def case_table() -> np.ndarray:
    """As :func:`white_table` without folding."""
    t = np.arange(256, dtype=np.uint16) + 1
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


WHITE, ALNUM = white_table(), alnum_table()


def _hash_block(raw: np.ndarray, row_starts: np.ndarray, table: np.ndarray):
    """Word hashes and first bytes of ``raw``; a word never runs over a row start."""
    sym = table[raw]
    word = sym > 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = row_starts[row_starts < len(raw)]
    first[edge] = word[edge]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), at
    inside = np.flatnonzero(word)
    which = np.cumsum(first[inside]) - 1
    offset = inside - at[which]
    mult = _multipliers(int(offset.max()) + 1)
    with np.errstate(over="ignore"):
        terms = mult[offset] * sym[inside].astype(np.uint64)
        begin = np.searchsorted(inside, at)
        h = np.add.reduceat(terms, begin)
    return splitmix(h), at


def text_column(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (len + 1) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    buf = col.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64, count=len(col) + col.offset + 1)[col.offset:]
    raw = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return raw, off


def iter_words(col, table: np.ndarray = WHITE):
    """Yield (first row, rows, word hashes, word offsets per row) for runs of rows of
    about BLOCK_BYTES. A longer row comes alone; it is hashed in pieces cut between
    words, so memory follows its words (8 bytes each), not its bytes."""
    raw, off = text_column(col)
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        lo, hi = int(off[row]), int(off[end])
        if hi - lo <= BLOCK_BYTES:
            h, at = _hash_block(raw[lo:hi], off[row:end] - lo, table)
            bounds = np.searchsorted(at, off[row:end + 1] - lo)
            yield row, end - row, h, bounds
        else:  # one long row
            parts, p = [], lo
            while p < hi:
                q = min(p + BLOCK_BYTES, hi)
                while q < hi and table[raw[q]] and q - p < 64 * BLOCK_BYTES:
                    q += 1
                parts.append(_hash_block(raw[p:q], np.zeros(1, np.int64), table)[0])
                p = q
            h = np.concatenate(parts)
            yield row, 1, h, np.array([0, len(h)])
        row = end


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    coef = splitmix(np.arange(1, k + 1, dtype=np.uint64) * _U(0x100000001B3)) | _U(1)
    with np.errstate(over="ignore"):
        out = h[:m] * coef[0]
        for j in range(1, k):
            out += h[j:j + m] * coef[j]
    return splitmix(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """``k``-word shingle hashes of one text in order; fewer than ``k`` words: the
    whole sequence as one shingle; no words: none."""
    if 0 < len(h) < k:
        return splitmix(combine(h, len(h)) + _U(len(h)))
    return combine(h, k)


def hash_words(words, table: np.ndarray = WHITE) -> np.ndarray:
    """Hashes of single words (each must be one word under ``table``)."""
    out = []
    for _, _, h, _ in iter_words(pa.array([" ".join(words)]), table):
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
