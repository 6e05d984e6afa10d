"""Quality rules: learned decision lists, in DataFrame operations only.

Statistics of whole texts are native expressions. From labelled rows, sequential
covering grows a conjunction of thresholds (best weighted FOIL gain on the grow rows),
prunes it to those of its conditions with the best precision on the prune rows (of equals the
one that rejects more, then the shorter), keeps the rule if it is precise enough there,
removes what it covers, and repeats. Where a rule is not precise enough, its first
condition is barred and the next best is tried, up to ``ATTEMPTS`` times in all. Every step
is one grouped aggregate over (statistic, bin). Rules that a wider one of the list implies
are dropped. The list becomes one ordered CASE expression; rows that no rule covers are kept.

Null or empty texts have zero words. Repeated rows are judged alike; empty tables give an
empty result, no labelled or no bad rows an empty list. Columns of ``docs`` are carried
untouched, whatever their names; the statistics are fields of one struct ``__stats``.
Windows are compared by 64-bit hashes, of which the lowest bits (as many as the number of
windows needs) hold the place instead.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propel.llm.common import cut

WORD, BLANK, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
FEATURES = ["words", "symbols_per_word", "caps_ratio", "bangs_per_word", "dup_line_ratio", "repeat_ratio", "word_length", "digit_ratio"]
BINS, RULES, CONDITIONS, PRECISION, ATTEMPTS = 32, 8, 3, 0.9, 24
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: labelled rows that the rules are learned from (smallest hash of the id first)
MAX_LABELLED = 20_000


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the struct __stats of COUNTS and FEATURES."""
    count = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns({"n_words": F.size("w").cast("long"), "word_chars": (F.char_length("t") - count(BLANK)).cast("long"), "n_symbols": count(SYMBOLS),
                       "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long")})
    d = d.withColumn("g", F.expr("CASE WHEN n_words < 4 THEN array() ELSE transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])) END"))
    # only texts in which a window repeats need their places: (hash, place) in one number, sorted,
    # so that equal neighbours are repeats
    d = d.withColumn("k", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN CAST(ceil(log2(size(g) + 1)) AS INT) END"))
    d = d.withColumn("s", F.expr("CASE WHEN k IS NOT NULL THEN sort_array(transform(g, (h, i) -> shiftleft(h, k) | CAST(i AS BIGINT))) END"))
    d = d.withColumn("r", F.expr("CASE WHEN k IS NOT NULL THEN sort_array(transform(filter(s, (x, i) -> coalesce(shiftright(get(s, i - 1), k) = shiftright(x, k), false) "
                                 "OR coalesce(shiftright(get(s, i + 1), k) = shiftright(x, k), false)), x -> x & (shiftleft(1L, k) - 1L))) END"))
    d = d.withColumn("n_repeat_words", F.expr("CASE WHEN k IS NULL THEN 0L ELSE aggregate(r, struct(-3L AS last, 0L AS n), "
                                              "(a, x) -> struct(x AS last, a.n + least(3L, x - a.last) AS n), a -> a.n) END"))
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    ratios = {"words": F.col("n_words").cast("double"), "symbols_per_word": F.col("n_symbols") / n, "caps_ratio": count("[A-Z]") / c, "bangs_per_word": count("!") / n,
              "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("l"), F.lit(1)),
              "repeat_ratio": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n, "digit_ratio": count("[0-9]") / c}
    return d.select("doc.*", F.struct(*COUNTS, *[v.alias(k) for k, v in ratios.items()]).alias("__stats"))


def condition(c) -> Column:
    name, op, at = c
    return F.col(name) >= at if op == ">=" else F.col(name) < at


def conjunction(rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & condition(c)
    return out


def grow(left: DataFrame, cuts: dict, long: str, barred: set) -> list:
    """The conjunction with the best gain, condition by condition, on the grow rows."""
    rule = []
    for _ in range(CONDITIONS):
        at = left.where(~F.col("prune")).where(conjunction(rule))
        got = at.selectExpr("bad", long).groupBy("f", "b").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect()
        by = {}
        for x in got:  # at most BINS rows a statistic
            by.setdefault(x.f, {})[x.b] = (x.p, x.n)
        some = next(iter(by.values()), {})
        p0, n0 = sum(v[0] for v in some.values()), sum(v[1] for v in some.values())
        if not p0 or not n0:
            break
        best = (0.0, None)
        for f, h in sorted(by.items()):
            for k, x in enumerate(cuts[f]):
                hi = [sum(v[j] for b, v in h.items() if b > k) for j in (0, 1)]
                for op, (p, n) in ((">=", hi), ("<", (p0 - hi[0], n0 - hi[1]))):
                    c = (f, op, float(x))
                    if p >= 5 and (rule or c not in barred):
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        best = max(best, (gain, c), key=lambda z: z[0])
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def prune(left: DataFrame, rule: list) -> tuple[float, list]:
    """(precision, conditions) of the best subset of the rule's conditions on the prune rows."""
    subsets = [list(s) for k in range(1, len(rule) + 1) for s in combinations(rule, k)]
    tests = [F.struct(F.sum((conjunction(s) & F.col("bad")).cast("long")).alias("p"), F.sum(conjunction(s).cast("long")).alias("a")).alias(f"r{i}") for i, s in enumerate(subsets)]
    got = left.where("prune").agg(*tests).first()
    worth = [((x.p or 0) / x.a if x.a else 0.0, x.p or 0, -len(s), -i) for i, (x, s) in enumerate(zip(got, subsets))]
    top = max(worth)
    return top[0], subsets[-top[3]]


def implies(a: list, b: list) -> bool:
    """Whether every row that ``a`` covers is covered by ``b``."""
    return all(any(f == g and op == o and (x >= y if op == ">=" else x <= y) for f, op, x in a) for g, o, y in b)


def learn(rows: DataFrame) -> list:
    """Ordered rules [(statistic, '>=' or '<', threshold), ...] that reject, from FEATURES and
    ``bad`` (boolean). Two thirds of the rows (by hash) grow the rules, one third prunes."""
    rows = cut(rows.select(*FEATURES, "bad").where("bad IS NOT NULL").withColumn("prune", F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0), "quality-rows")
    q = rows.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(q[f] or [])) for f in FEATURES}
    cuts = {f: v for f, v in cuts.items() if v}
    if not cuts:
        return []
    bins = {f"b_{f}": F.expr(" + ".join(f"int({f} >= {float(x)!r}D)" for x in v)) for f, v in cuts.items()}
    rows = cut(rows.withColumns(bins), "quality-bins")
    long = "stack({}, {}) AS (f, b)".format(len(cuts), ", ".join(f"'{f}', b_{f}" for f in cuts))
    rules, barred = [], set()
    for _ in range(ATTEMPTS):
        left = rows
        for r in rules:
            left = left.where(~conjunction(r))
        rule = grow(left, cuts, long, barred)
        if not rule or len(rules) == RULES:
            break
        precision, kept = prune(left, rule)
        if precision < PRECISION:
            barred.add(rule[0])
        else:
            rules.append(kept)
    return [r for i, r in enumerate(rules) if not any(implies(r, o) for j, o in enumerate(rules) if j != i and (not implies(o, r) or j < i))]


def verdict(rules) -> Column:
    """Ordered CASE: the first rule that holds rejects; otherwise kept."""
    out = None
    for r in rules:
        out = F.when(conjunction(r), False) if out is None else out.when(conjunction(r), False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """FEATURES and ``bad`` of the documents with one of ``max_labelled`` labelled ids."""
    some = labels.select("doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    known = docs.select("doc_id", F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), "doc_id")       # max_labelled rows
    return statistics(known).select("__stats.*", (F.col("quality") == 0).alias("bad"))
