"""Token counts by a compiled finite-state tokenizer.

The pre-tokenizer and the byte-level merges of a BPE file become one deterministic
transducer over characters, compiled lazily: a state holds the mode of the current
piece and, for every suffix that may still grow into a token, the token before it and
its relative count; each transition carries the change in the number of tokens.
Texts are cut into chunks. A chunk's state map is (head, tokens, state): behind the
first non-blank-to-blank step every entry state leads to the same state, so the map
is the head, run from the entry state, then a constant. Maps compose associatively
and are combined by a prefix scan.

Null counts as empty. Special strings are single tokens, as by the library's default.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, MAX_STATES = 1 << 15, 400_000


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 in order."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(c: str) -> str:
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return "W"
    g = unicodedata.category(c)[0]
    return g if g in "LN" else "O"


class Transducer:
    """Counts tokens; ``step(state, char)`` gives (state, change in tokens)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        to = _byte_chars()
        raw = lambda s: bytes(to[c] for c in s)
        self.rank, self.parts = {}, {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            self.rank[a, b] = i
            self.parts[a + b] = (a, b, i)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.tokens = set(self.parts) | {bytes([b]) for b in range(256)}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fits: dict = {}
        self.flush()

    def flush(self):
        self.states: dict = {}
        self.start = self._state(("S",))

    def _state(self, key):
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = {0: key}
        return s

    def _spine(self, t: bytes, side: int):
        """(part, rank at which it is swallowed) down one edge of a token's merge tree."""
        out, up = [], 1 << 60
        while True:
            out.append((t, up))
            if t not in self.parts:
                return out
            up, t = self.parts[t][2], self.parts[t][side]

    def _fit(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a, b stay apart side by side: no pair of parts on their border
        merges before one of them is swallowed (the left pair wins ties)."""
        r = self.fits.get((a, b))
        if r is None:
            r = True
            for x, px in self._spine(a, 1):
                for y, py in self._spine(b, 0):
                    m = self.rank.get((x, y))
                    if m is not None and m < px and m <= py:
                        r = False
            self.fits[a, b] = r
        return r

    def _grow(self, bpe, data: bytes):
        """bpe: ((suffix, token before it or None, tokens up to there less those up to here), ...)."""
        change = 0
        for i in range(len(data)):
            b = data[i:i + 1]
            last, more, cost = None, [], 0
            for suffix, before, n in bpe:
                t = suffix + b
                if last is None and t in self.tokens and (before is None or self._fit(before, t)):
                    last, cost = t, n + 1
                if t in self.prefixes:
                    more.append((t, before, n))
            change += cost
            bpe = tuple((t, before, n - cost) for t, before, n in more) + ((b"", last, 0),)
        return bpe, change

    def _fresh(self, data: str):
        return self._grow(((b"", None, 0),), data.encode())

    def _next(self, key, c: str):
        mode, kind, data = key[0], _kind(c), c.encode()
        if mode == "W":
            _, bpe, diff, last = key
            if kind == "W":
                bpe, n = self._grow(bpe, data)
                return ("W", bpe, -n, c), n
            if last == " ":  # the blank joins the piece
                bpe, n = self._fresh(" " + c)
                return (kind, bpe), diff + n
            n0 = diff + self._fresh(last)[1]
            key, n = self._next(("S",), c)
            return key, n0 + n
        if mode == "R" and c == ("l" if key[1] == "l" else "e"):  # 're 've 'll
            whole = self._fresh("'" + key[1] + c)[1]
            return ("S",), whole - self._fresh("'")[1] - self._fresh(key[1])[1]
        if mode == "A":
            if c in "stmd":
                return ("S",), self._fresh("'" + c)[1] - self._fresh("'")[1]
            if c in "rvl":
                return ("R", c), self._fresh(c)[1]
            mode, key = "O", ("O", self._fresh("'")[0])
        if mode == "R":
            mode, key = "L", ("L", self._fresh(key[1])[0])
        if mode == kind and kind in "LNO":
            bpe, n = self._grow(key[1], data)
            return (kind, bpe), n
        bpe, n = self._fresh(c)
        if kind == "W":
            return ("W", bpe, -n, c), n
        return (("A",) if c == "'" else (kind, bpe)), n

    def step(self, state, c):
        key, n = self._next(state[0], c)
        to = self._state(key)
        state[c] = (to, n)
        return to, n

    def run(self, state, text: str):
        total = 0
        for c in text:
            try:
                state, n = state[c]
            except KeyError:
                state, n = self.step(state, c)
            total += n
        return state, total

    def chunk_map(self, text: str, first: bool):
        """(head, tokens, state key): head must be run from the entry state."""
        if first:
            s, n = self.run(self.start, text)
            return "", n, s[0]
        for i in range(1, len(text)):
            if text[i] in " \n" and not text[i - 1].isspace():
                bpe, n = self._fresh(text[i])
                s, m = self.run(self._state(("W", bpe, -n, text[i])), text[i + 1:])
                return text[:i + 1], m, s[0]
        return text, None, None

    def compose(self, a, b):
        """First a, then b."""
        if b[2] is None and a[2] is None:
            return a[0] + b[0], None, None
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        s, n = self.run(self._state(a[2]), b[0])
        return (a[0], a[1] + n, s[0]) if b[2] is None else (a[0], a[1] + n + b[1], b[2])

    def count(self, text: str, chunk: int = CHUNK) -> int:
        pieces, total = [text], 0
        for sp in self.special:
            pieces = [x for p in pieces for x in p.split(sp)]
        total = len(pieces) - 1
        for p in pieces:
            maps = [self.chunk_map(p[i:i + chunk], i == 0) for i in range(0, len(p), chunk)]
            while len(maps) > 1:  # neighbours pairwise: the up-sweep of a prefix scan
                maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            total += maps[0][1] if maps else 0
        if len(self.states) > MAX_STATES:
            self.flush()
        if len(self.fits) > 4 * MAX_STATES:
            self.fits = {}
        return total


_LOADED: dict[str, Transducer] = {}


def _count_batches(path: str, chunk: int):
    def run(batches):
        t = _LOADED.get(path) or _LOADED.setdefault(path, Transducer(path))
        for b in batches:
            n = [t.count(x.as_py() or "", chunk) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(n, pa.int64())], b.schema.names[1:] + ["n_tokens"])
    return run


def count_tokens(docs: DataFrame, path: str, keep: list, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``keep`` (columns) of every row plus n_tokens."""
    src = docs.select(F.col(f"`{text_col}`").alias("__t"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(_count_batches(path, chunk), f"{schema}, n_tokens long")
