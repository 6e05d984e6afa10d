"""Words of Arrow text columns by place: start, length and folded bytes, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

from propel.llm.wordhash import BLOCK_BYTES, _multipliers, splitmix, text_column


def blocks(col, table: np.ndarray):
    """Yield (first row, rows, folded bytes, word starts, word lengths, word offsets per row)
    for runs of whole rows of about BLOCK_BYTES (a longer row comes alone). Separators are
    0 in the folded bytes."""
    raw, off = text_column(col)
    fold = np.where(table > 0, table - 1, 0).astype(np.uint8)
    inside = table > 0
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        lo, hi = int(off[row]), int(off[end])
        part = raw[lo:hi]
        word = inside[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edge = off[row:end] - lo
        edge = edge[edge < hi - lo]
        first[edge] = word[edge]
        at = np.flatnonzero(first)
        # a word ends before the next separator or row start
        stop = ~word
        stop[edge] = True
        stop &= ~first
        gap = np.append(np.flatnonzero(stop | first), hi - lo)
        length = gap[np.searchsorted(gap, at, side="right")] - at
        yield row, end - row, fold[part], at, length, np.searchsorted(at, off[row:end + 1] - lo)
        row = end


def flat(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, offsets): the places of all bytes of the words, one word after the other."""
    begin = np.concatenate([[0], np.cumsum(length)])
    places = np.arange(begin[-1]) + np.repeat(at - begin[:-1], length)
    return places, begin


def hashes(b: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    if not len(at):
        return np.zeros(0, np.uint64)
    places, begin = flat(at, length)
    mult = _multipliers(int(length.max()) + 1)
    with np.errstate(over="ignore"):
        terms = mult[places - np.repeat(at, length)] * (b[places].astype(np.uint64) + np.uint64(1))
        return splitmix(np.add.reduceat(terms, begin[:-1]) + length.astype(np.uint64))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()
SHORT = 48


def _shift_tables(n: int) -> np.ndarray:
    """[length, byte of the state, value]: the CRC state after ``length`` zero bytes."""
    out = np.zeros((n + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for i in range(n):
        out[i + 1] = CRC[out[i] & 255] ^ (out[i] >> np.uint32(8))
    return out


SHIFT = _shift_tables(SHORT)


def _apply(t: np.ndarray, s: np.ndarray) -> np.ndarray:
    return t[0][s & 255] ^ t[1][(s >> 8) & 255] ^ t[2][(s >> 16) & 255] ^ t[3][s >> 24]


def shift(s: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states ``s`` after ``length`` zero bytes each (any length)."""
    s = s.copy()
    for v in np.flatnonzero(np.bincount(np.minimum(length, SHORT + 1))):
        which = np.flatnonzero(np.minimum(length, SHORT + 1) == v)
        if v <= SHORT:
            s[which] = _apply(SHIFT[v], s[which])
            continue
        t, left = SHIFT[1], length[which].copy()     # by squaring
        while left.any():
            odd = which[(left & 1) == 1]
            s[odd] = _apply(t, s[odd])
            t, left = _apply(t, t), left >> 1
    return s


def crcs(b: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of every word's folded bytes."""
    out = np.zeros(len(at), np.uint32)
    order = np.argsort(length, kind="stable")
    order = order[length[order] <= SHORT]
    size, s = length[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(int(size[-1]) if len(size) else 0):
        j = int(np.searchsorted(size, i, side="right"))      # the words longer than i
        s[j:] = CRC[(s[j:] ^ b[at[order[j:]] + i]) & 255] ^ (s[j:] >> np.uint32(8))
    out[order] = ~s
    for w in np.flatnonzero(length > SHORT):
        out[w] = zlib.crc32(b[at[w]:at[w] + length[w]].tobytes())
    return out


def joined_crcs(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of every word with the next one, joined by one space."""
    if len(c) < 2:
        return np.zeros(0, np.uint32)
    s = ~c[:-1]
    s = ~(CRC[(s ^ np.uint32(32)) & 255] ^ (s >> np.uint32(8)))
    return shift(s, length[1:]) ^ c[1:]
