"""Word-wise language ID: forward-backward against enumeration, gradient, held-out accuracy, edges."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID

from propel.llm import langid
from propel.llm import queries as Q
from propel.llm.wordspan import blocks


def paths(e, trans):
    """(label probabilities, expected transitions) by all label sequences."""
    n, k = e.shape
    gamma, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for y in itertools.product(range(k), repeat=n):
        p = sum(np.exp(trans[i, y[0]]) for i in range(k)) * np.exp(sum(e[t, y[t]] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
        total += p
        for t in range(n):
            gamma[t, y[t]] += p
            if t:
                pairs[y[t - 1], y[t]] += p
    return gamma / total, pairs / total


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_forward_backward(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    sizes = [1, 7, 3, 8, 2]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    e, trans = rng.normal(size=(bounds[-1], 3)) * 3, rng.normal(size=(3, 3))
    gamma, pairs = langid.forward_backward(e, bounds, trans)
    want = [paths(e[a:b], trans) for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(gamma, np.concatenate([w[0] for w in want]))
    assert np.allclose(pairs, sum(w[1] for w in want))


def test_word_features_are_those_of_each_word():
    one = next(blocks(pa.array(["Über ab\x00a abc straße " + "x" * 5000]), langid.LETTERS))
    _, _, b, at, n, _ = one
    f, w = langid.word_features(b, at, n)
    for i in range(len(at)):
        g, _ = langid.word_features(b[at[i]:at[i] + n[i]], np.array([0]), n[i:i + 1])
        assert sorted(f[w == i].tolist()) == sorted(g.tolist())
        long = int(n[i])
        assert (w == i).sum() == (long + 1) + long + 2 * min(long, 4) + 1


def test_code_switched_runs(spark):
    rng = random.Random(2)
    bags = {"aa": ["bada", "dabo", "gado", "dab"], "bb": ["kiti", "tik", "pikite", "etik"], "cc": ["шум", "мушу", "уш"]}
    say = lambda lang, n: " ".join(rng.choice(bags[lang]) for _ in range(n))
    model = langid.train([(lang, say(lang, 32)) for lang in bags for _ in range(40)])
    assert (np.diag(model["trans"])[:, None] >= model["trans"]).all()
    text = say("aa", 40) + ". " + say("cc", 90) + "! " + say("bb", 30)
    rows = [(1, text, "x", 7, 1.5), (2, None, "x", 7, 1.5), (3, "", "x", 7, 1.5), (4, "12 !? — ·", "x", 7, 1.5), (5, "TIK", "x", 7, 1.5), (5, "TIK", "x", 7, 1.5),
            (6, say("bb", 20_000), "x", 7, 1.5), (None, say("aa", 3), "x", 7, 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, runs int, score double")
    out = langid.predict(df, model)
    assert out.columns[:5] == df.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(x.lang, x.start, x.words) for x in got[1][0]["__runs"]] == [("aa", 0, 40), ("cc", 40, 90), ("bb", 130, 30)]
    assert got[1][0]["__lang_pred"] == "cc" and got[1][0]["__n_words"] == 160 and 0.5 < got[1][0]["__score"] < 0.6
    for i in (2, 3, 4):
        assert (got[i][0]["__lang_pred"], got[i][0]["__score"]) == ("und", 0.0)
    assert [r["__lang_pred"] for r in got[5]] == ["bb", "bb"] and got[None][0]["__lang_pred"] == "aa"
    assert got[6][0]["__lang_pred"] == "bb" and got[6][0]["__n_words"] == 20_000 and len(got[6][0]["__runs"]) == 1
    assert langid.predict(df.limit(0), model).count() == 0
    nothing = langid.predict(df, langid.train([])).collect()
    assert {(r["__lang_pred"], r["__score"]) for r in nothing} == {("und", 0.0)}


def test_sample_is_bounded_and_from_the_learning_rows(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} " * 100, ["a", "b"][i % 7 == 0]) for i in range(300)] + [(9, "copy copy", "a")] * 50
    rows += [(None, "x y", "a"), (400, None, "a"), (401, "q r", None), (402, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample_spans(df, F.crc32(F.col("doc_id").cast("string")) % 3 != 1, max_rows=20)
    assert 0 < len(got) <= 20 * langid.SPANS
    assert {lang for lang, _ in got} == {"a", "b"}
    assert langid.sample_spans(df.limit(0), F.lit(True)) == []


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF_MID}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = Q.QUERIES["op11_crf_language_id"](spark, SF_MID).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id] is not None]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    assert right > 0.97, right
