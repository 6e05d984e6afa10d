"""The rule learner against a plain Python one, and the verdict on whole tables."""

import itertools
import math
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF_MID

from propel.llm import quality_rules as qr
from propel.llm import queries as Q


def holds(rule, r):
    return all(r[f] >= x if op == ">=" else r[f] < x for f, op, x in rule)


def naive(rows):
    """Rows: dicts with FEATURES, bad and prune."""
    cuts = {}
    for f in qr.FEATURES:
        v = sorted(r[f] for r in rows)
        cuts[f] = sorted({v[max(math.ceil(i / qr.BINS * len(v)), 1) - 1] for i in range(1, qr.BINS)})
    rules, barred = [], set()
    for _ in range(qr.ATTEMPTS):
        left = [r for r in rows if not any(holds(x, r) for x in rules)]
        rule = []
        for _ in range(qr.CONDITIONS):
            at = [r for r in left if not r["prune"] and holds(rule, r)]
            p0, n0 = sum(r["bad"] for r in at), sum(not r["bad"] for r in at)
            best = (0.0, None)
            if p0 and n0:
                for f in sorted(qr.FEATURES):
                    for x in cuts[f]:
                        for op in (">=", "<"):
                            in_ = [r for r in at if holds([(f, op, x)], r)]
                            p, n = sum(r["bad"] for r in in_), sum(not r["bad"] for r in in_)
                            if p >= 5 and (rule or (f, op, x) not in barred):
                                best = max(best, (p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), (f, op, x)), key=lambda z: z[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule or len(rules) == qr.RULES:
            break
        held = [r for r in left if r["prune"]]
        worth = []
        for i, s in enumerate([list(s) for k in range(1, len(rule) + 1) for s in itertools.combinations(rule, k)]):
            a = [r for r in held if holds(s, r)]
            p = sum(r["bad"] for r in a)
            worth.append((p / len(a) if a else 0.0, p, -len(s), -i, s))
        top = max(worth, key=lambda z: z[:4])
        if top[0] < qr.PRECISION:
            barred.add(rule[0])
        else:
            rules.append(top[4])
    return rules


def test_learner_equals_a_plain_one(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        r = {f: round(rng.random(), 3) for f in qr.FEATURES}
        r["bad"] = r["words"] > 0.8 or (r["caps_ratio"] > 0.6 and r["digit_ratio"] < 0.3) or rng.random() < 0.03
        rows.append(r)
    df = spark.createDataFrame([tuple(r[f] for f in qr.FEATURES) + (r["bad"],) for r in rows], ", ".join(f"{f} double" for f in qr.FEATURES) + ", bad boolean")
    marked = [r.asDict() for r in df.withColumn("prune", F.pmod(F.xxhash64(*qr.FEATURES), F.lit(3)) == 0).collect()]
    want = naive(marked)
    want = [r for i, r in enumerate(want) if not any(qr.implies(r, o) for j, o in enumerate(want) if j != i and (not qr.implies(o, r) or j < i))]
    got = qr.learn(df)
    assert got and got == want
    kept = df.withColumn("kept", qr.verdict(got)).collect()
    assert [r.kept for r in kept] == [not any(holds(x, r) for x in got) for r in kept]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], ", ".join(f"{f} double" for f in qr.FEATURES) + ", bad boolean")
    assert qr.learn(empty) == []
    good = spark.createDataFrame([(1.0,) * len(qr.FEATURES) + (False,)] * 9, empty.schema)
    assert qr.learn(good) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c a b c", "x", 2, [3], 4), (2, None, "x", 2, [3], 4)], "doc_id long, text string, words string, n_words int, w array<int>, t int")
    out = qr.statistics(df)
    assert out.columns == [*df.columns, "__stats"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].words == "x" and got[1].n_words == 2 and got[1]["__stats"].n_words == 6 and got[1]["__stats"].n_repeat_words == 6
    assert got[2]["__stats"].n_words == 0
    assert qr.statistics(df.limit(0)).count() == 0


def test_rules_reject_on_whole_tables(spark):
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF_MID}/labels.parquet").to_pylist()}
    rows = Q.QUERIES["op6_quality_rules"](spark, SF_MID).collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.base_failed and r.kept for r in rows)
    bad = [r for r in rows if quality.get(r.doc_id) == 0]
    good = [r for r in rows if quality.get(r.doc_id) == 1]
    beyond = [r for r in rows if not r.base_failed and not r.kept]
    assert beyond                                             # the list is not empty
    assert sum(not r.kept for r in bad) > sum(r.base_failed for r in bad)
    assert sum(r.kept for r in good if not r.base_failed) >= 0.95 * sum(not r.base_failed for r in good)
