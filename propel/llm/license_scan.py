"""License scans by a positional rare-token index.

Licence templates are indexed by word with positions. The document frequency of every
licence word is counted over all texts. In each text the words of highest IDF are
looked up first: the rarest word of a template anchors an alignment (place in the text
less place in the template), the other words' postings are intersected at the same
alignment, and a template counts when enough of its words agree and its mandatory key
phrase stands there word by word. Short base phrases must agree in all words.
Null and empty texts have no words and no labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propel.llm.wordhash import ALNUM, hash_words, iter_words

# fixed values: base phrases and labels
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# templates: words, label, mandatory key phrase
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", "public license version 3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", "public license version 2"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("released under the mit license", "mit-release", "mit license"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-text", "hereby granted free of charge"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text", "source and binary forms"),
    ("mozilla public license version 2 0", "mpl-2.0", "mozilla public license version 2 0"),
]
AGREE = 0.7


class Index:
    def __init__(self, df: dict[int, int] | None = None):
        self.entries = [(p, label, p, 1.0) for p, label in BASE] + [(t, label, key, AGREE) for t, label, key in TEMPLATES]
        vocab = sorted({w for e in self.entries for w in e[0].split()})
        h = hash_words(vocab, ALNUM)
        order = np.argsort(h)
        self.hash, ids = h[order], {vocab[j]: i for i, j in enumerate(order)}
        self.words = [[ids[w] for w in e[0].split()] for e in self.entries]
        self.keys = [[ids[w] for w in e[2].split()] for e in self.entries]
        self.df = np.array([(df or {}).get(int(x), 0) for x in self.hash.view(np.int64)])
        self.gate = np.zeros(1 << 16, bool)
        self.gate[self.hash & np.uint64(0xFFFF)] = True

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Licence word of each place, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.gate[h & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        ok = self.hash[at] == h[maybe]
        out[maybe[ok]] = at[ok]
        return out

    def scan(self, ids: np.ndarray):
        """[(entry, start, share of words that agree)] in one text."""
        places, out = {}, []
        where = np.flatnonzero(ids >= 0)
        if len(where) < 2:
            return out
        present = set(ids[where].tolist())
        for e, words in enumerate(self.words):
            # a text that agrees in enough words holds one of the rarest of them
            spare = len(words) - int(np.ceil(self.entries[e][3] * len(words) - 1e-9))
            rare = sorted(range(len(words)), key=lambda q: (self.df[words[q]], q))[:spare + 1]
            starts = set()
            if not set(self.keys[e]) <= present:
                continue
            for q in rare:
                if words[q] not in places:
                    places[words[q]] = where[ids[where] == words[q]]
                starts.update((places[words[q]] - q).tolist())
            for s in sorted(starts):
                agree = sum(0 <= s + q < len(ids) and ids[s + q] == w for q, w in enumerate(words))
                if agree >= self.entries[e][3] * len(words) - 1e-9 and self._key(ids, self.keys[e], s, len(words)):
                    out.append((e, max(s, 0), agree / len(words)))
        return out

    @staticmethod
    def _key(ids, key, start, n) -> bool:
        for s in range(max(start, 0), min(start + n, len(ids)) - len(key) + 1):
            if all(ids[s + i] == w for i, w in enumerate(key)):
                return True
        return False


def _df_batches(batches):
    index = Index()
    for b in batches:
        n = np.zeros(len(index.hash), np.int64)
        for _, rows, h, bd in iter_words(b.column(0), ALNUM):
            ids = index.ids(h)
            for i in range(rows):
                u = np.unique(ids[bd[i]:bd[i + 1]])
                n[u[u >= 0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(index.hash.view(np.int64)), pa.array(n)], ["h", "n"])


def frequencies(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Document frequency of each licence word over all texts (one number a word)."""
    got = docs.select(F.col(f"`{text_col}`")).mapInArrow(_df_batches, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {r.h: r.n for r in got}


def _scan_batches(bc):
    def run(batches):
        index = bc.value
        base = len(BASE)
        for b in batches:
            cols = [[] for _ in range(7)]
            for _, rows, h, bd in iter_words(b.column(0), ALNUM):
                ids = index.ids(h)
                for i in range(rows):
                    found = index.scan(ids[bd[i]:bd[i + 1]])
                    at = [s for e, s, _ in found if e < base]
                    own = sorted({index.entries[e][1] for e, _, _ in found if e < base})
                    every = sorted({index.entries[e][1] for e, _, _ in found})
                    for c, v in zip(cols, (int(bd[i + 1] - bd[i]), len(at), min(at, default=None), max(at, default=None),
                                           ",".join(own), ",".join(every), max((a for _, _, a in found), default=0.0))):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(c, k) for c, k in zip(cols, kinds)], b.schema.names[1:] + OUT)
    return run


OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every text plus word count, base places, labels and score."""
    bc = docs.sparkSession.sparkContext.broadcast(Index(frequencies(docs, text_col)))
    src = docs.select(F.col(f"`{text_col}`").alias("__t"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(_scan_batches(bc), f"{schema}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
