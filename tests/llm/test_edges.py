"""Clashing columns, empty sources, self-closed elements, empty tables."""

import random

from propel.llm import decontaminate, entropy_mix, html_extract, near_dedup, shard

NAMES = "doc_id long, text string, source string, s string, n int, c int, size long, target double, source_size int, score int, labels string, words int, shard int, b int, o int, key int, doc int, rank int"


def table(spark, texts, sources=None):
    rows = [(i, t, (sources or ["x"] * len(texts))[i], "s", 1, 2, 3, 4.0, 5, 6, "l", 7, 8, 9, 10, 11, 12, 13) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, NAMES)


def test_mix_sources_without_words(spark):
    texts = ["a b c"] * 30 + [""] * 4 + ["   "] + [None] * 3 + ["q"] * 5
    df = table(spark, texts, ["x"] * 30 + ["y"] * 8 + ["z"] * 5)
    out = entropy_mix.mix(df)
    assert out.columns == [*df.columns, "__size", "__source_size", "__target", "__copies"]
    rows = out.collect()
    assert len(rows) == len(texts)
    empty = [r for r in rows if r.source == "y"]
    assert all((r["__size"], r["__source_size"], r["__target"], r["__copies"]) == (0, 0, 0.0, 1) for r in empty)
    for s, size in (("x", 90), ("z", 5)):
        got = [r for r in rows if r.source == s]
        assert abs(sum(r["__copies"] * r["__size"] for r in got) - got[0]["__target"]) <= 3 and got[0]["__source_size"] == size
        assert all(r["__copies"] <= 2 for r in got)
    only = entropy_mix.mix(table(spark, ["", None, " "])).collect()
    assert [r["__copies"] for r in only] == [1, 1, 1]
    assert entropy_mix.mix(df.limit(0)).count() == 0


def dual_optimum(sizes, target, cap=2.0):
    """lambda of min(cap, exp(lambda * size / mean)) that meets the target, by bisection."""
    import math
    mean = sum(sizes) / len(sizes)
    lo, hi = -60.0, 60.0
    for _ in range(200):
        lam = (lo + hi) / 2
        got = sum(s * min(cap, math.exp(min(lam * s / mean, math.log(cap)))) for s in sizes)
        lo, hi = (lam, hi) if got < target else (lo, lam)
    return lam


def test_mix_finds_the_dual_optimum(spark):
    rng = random.Random(4)
    sizes = {s: [rng.randint(1, 60) for _ in range(n)] for s, n in (("x", 80), ("y", 50), ("z", 40))}
    hist = spark.createDataFrame([(s, z, 1) for s, zs in sizes.items() for z in zs], "source string, size long, n long")
    hist = hist.groupBy("source", "size").sum("n").withColumnRenamed("sum(n)", "n")
    goal = {"x": 1.4, "y": 0.6, "z": 1.0}
    tgt = spark.createDataFrame([(s, goal[s] * sum(zs), sum(zs)) for s, zs in sizes.items()], "source string, target double, source_size long")
    got = {r.source: r.lam for r in entropy_mix.solve(hist, tgt).collect()}
    for s, zs in sizes.items():
        assert abs(got[s] - dual_optimum(zs, goal[s] * sum(zs))) < 2e-4


def test_shards_carry_columns(spark):
    df = table(spark, [f"t{i % 7}" for i in range(200)]).repartition(3)
    out = shard.shard_rows(df, 16)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    sizes = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) and len(v) in (12, 13) for v in sizes.values())
    assert shard.shard_rows(df.limit(0), 16).count() == 0


def test_raw_elements_keep_the_page():
    more = " ".join(f"<p>Paragraph {i} has some words of its own to say.</p>" for i in range(20))
    text = "Start here now. " + " ".join(f"Paragraph {i} has some words of its own to say." for i in range(20))
    for raw in ("<svg class=i/>", "<svg class=i />", "<iframe src=x />", "<button>", "<select>", "<textarea>", "<iframe src=x>", "<svg><path d='m'/></svg>"):
        assert html_extract.main_text(f"<body><article><p>Start here now.</p>{raw}{more}</article></body>") == text, raw
    assert html_extract.main_text(f"<body><article><p>Start here now.</p>{more}</article><script>var a = 1;") == text
    said = "<ul class='responses'><li>Nice one, thanks for it.</li></ul>"
    assert html_extract.main_text(f"<body><article><p>Start here now.</p>{more}{said}</article></body>") == text


def test_text_ids(spark):
    w = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([("b", w), ("a", w + " end"), ("c", "other words here"), (None, w)], "doc_id string, text string")
    got = {r.id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: ("a", False)}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def edited(words, share, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_windows_by_all_pairs(spark):
    """Items in texts at every similarity from 0.5 to 1, against all windows of item size."""
    rng = random.Random(8)
    items = [[f"i{j}x{k}" for k in range(rng.randint(12, 60))] for j in range(25)]
    texts = []
    for j, it in enumerate(items):
        for share in (0.0, 0.02, 0.04, 0.06, 0.1):
            at = rng.randint(0, 30)
            texts.append([f"f{rng.randrange(500)}" for _ in range(at)] + edited(it, share, rng) + [f"g{rng.randrange(500)}" for _ in range(20)])

    def grams(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]

    def best(text, item):
        want, top = grams(item), 0.0
        for s in range(max(len(text) - len(item), 0) + 1):
            have = grams(text[s:s + len(item)])
            a, b = {g: have.count(g) for g in set(have)}, {g: want.count(g) for g in set(want)}
            up = sum(min(a.get(g, 0), b.get(g, 0)) for g in a.keys() | b.keys())
            top = max(top, up / sum(max(a.get(g, 0), b.get(g, 0)) for g in a.keys() | b.keys()))
        return top
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    found = {r[0] for r in decontaminate.contamination(df, bench).collect()}
    want = {i for i, t in enumerate(texts) if any(best(t, it) >= 0.8 for it in items)}
    assert 25 < len(want) < len(texts) and found == want
