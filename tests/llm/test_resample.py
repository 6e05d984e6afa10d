"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa

from propel.llm import resample, wordspan
from propel.llm.wordhash import ALNUM


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def features(t):
    w = words(t)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [a + " " + b for a, b in zip(w, w[1:])]]


def brute(rows, target, least=20):
    """(id, n, weight, score) and the drawn ids in order."""
    s, t = [0] * 10000, [0] * 10000
    for _, x in rows:
        for f in features(x):
            s[f] += 1
    for x in target:
        for f in features(x):
            t[f] += 1
    big_s, big_t, out = sum(s), sum(t), []
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    for i, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return [r[:4] for r in out], [r[0] for r in may[:25 * len(may) // 100]]


def test_crcs_of_words_and_pairs():
    texts = ["Hello wörld, a b c", None, "", "x" * 100 + " y", "aA-bB", "z", "中文 abc " + "q" * 49 + " r", "a" * 48 + "!" + "b" * 300000]
    for row, rows, b, at, n, bd in wordspan.blocks(pa.array(texts), ALNUM):
        c, j = wordspan.crcs(b, at, n), wordspan.joined_crcs(wordspan.crcs(b, at, n), n)
        for i in range(rows):
            w = words(texts[row + i])
            assert [zlib.crc32(x.encode()) for x in w] == c[bd[i]:bd[i + 1]].tolist()
            assert [zlib.crc32(f"{x} {y}".encode()) for x, y in zip(w, w[1:])] == j[bd[i]:max(bd[i], bd[i + 1] - 1)].tolist()


def test_against_brute_force_with_edges(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(80)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 19, 20, 21, 60])))) for i in range(700)]
    rows += [(1000, None), (1001, ""), (1002, "!? \n"), (1003, "Z" * 200_000 + " tail " * 30), (None, "a b " * 15)]
    target = [" ".join(rng.choice(vocab[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(*r, 1, "x", 2.0, i) for i, r in enumerate(rows)],
                               "doc_id long, text string, score int, words string, n double, row int").repartition(7)
    tg = spark.createDataFrame([(t,) for t in target], "text string")
    want, drawn = brute(rows, target)
    for finish in (4096, 8):             # 8: the cutoff comes from medians of medians
        monkeypatch.setattr(resample, "FINISH", finish)
        out = resample.resample(df, tg)
        assert out.columns[:6] == df.columns
        got = out.collect()
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(((r.doc_id, r["__n_features"], r["__weight"], r["__score"]) for r in got), key=key) == sorted(want, key=key)
        assert [r.doc_id for r in sorted((r for r in got if r["__rank"]), key=lambda r: r["__rank"])] == drawn
        assert sorted(r["__rank"] for r in got if r["__rank"]) == list(range(1, len(drawn) + 1))
        assert sorted(r.row for r in got) == list(range(len(rows)))


def test_repeated_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(resample, "FINISH", 2)
    same = spark.createDataFrame([(5, "a b c d " * 6)] * 40 + [(None, "a b c d " * 6)] * 7 + [(6, "q")], "doc_id long, text string")
    out = resample.resample(same, same).collect()
    assert len(out) == 48
    assert sorted(r["__rank"] for r in out if r["__rank"]) == list(range(1, 25 * 47 // 100 + 1))
    assert {r.doc_id for r in out if r["__rank"]} in ({5}, {None})       # ties of one score and id, by row number
    none = same.limit(0)
    assert resample.resample(none, same).count() == 0
    full = resample.resample(same, none).collect()
    assert len(full) == 48 and all(r["__weight"] <= 0 for r in full)
