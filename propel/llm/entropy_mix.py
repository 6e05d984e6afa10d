"""Mixing by entropy balancing, in DataFrame operations only.

Rates minimise relative entropy to one copy per document under one token
constraint per source and a ceiling of ``cap`` copies: ``min(cap, exp(lambda * size /
mean))``. Safeguarded Newton steps on the convex dual run as grouped aggregates over
the (source, size) counts. Copies follow by systematic rounding along size, so the
error stays within about one document a source.

Null and empty texts have size 0 and cost nothing; a source that holds only such texts
has target 0 and each of its documents stays once. The null source is a source of its own. Rows
that agree in all columns are alike: which of them is taken twice does not matter.
Empty tables give empty results. Columns of ``docs`` are carried untouched, whatever their
names (but for the four results).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propel.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
GROUP = 4096


def targets(totals: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size): water-filling under ``cap``; a row per source."""
    w = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    t = totals.withColumn("r", (F.row_number().over(w) - 1) % len(weights))
    t = cut(t.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("r").cast("int") + 1))
            .withColumn("top", cap * F.col("source_size")), "mix-sources")
    total = share * (t.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("top") < level * F.col("w")
        s = t.agg(F.sum(F.when(full, F.col("top"))).alias("c"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        new = (total - (s.c or 0.0)) / s.w if s.w else 0.0
        if level is not None and new <= level * (1 + 1e-12) or not s.w:
            break
        level = new
    return t.withColumn("target", F.least("top", F.lit(level or 0.0) * F.col("w")))


def solve(hist: DataFrame, tgt: DataFrame, cap: float = 2.0, rounds: int = 60, tol: float = 1e-5) -> DataFrame:
    """(source, lam, mean, target, source_size): dual variable of each source that has words."""
    base = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
                                      F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"))
    words = base.where("least_size IS NOT NULL").withColumnRenamed("source", "s2")
    st = tgt.select("source", "target", "source_size").join(words, F.expr("source <=> s2")).drop("s2")
    hi = F.log(F.lit(cap)) * F.col("mean") / F.col("least_size")
    st = cut(st.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-1e6)).withColumn("hi", F.coalesce(hi, F.lit(0.0))), "mix-dual")
    for _ in range(rounds):
        j = hist.join(st.withColumnRenamed("source", "s2"), F.expr("source <=> s2"))
        u = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.log(F.lit(cap)), F.col("lam") * u))
        g = j.groupBy("s2").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                                F.sum(F.when(rate < cap, F.col("n") * F.col("size") * u * rate).otherwise(0.0)).alias("slope"))
        x = st.join(g, F.expr("source <=> s2"), "left").drop("s2")
        err = F.col("got") - F.col("target")
        x = x.withColumn("lo", F.when(err < 0, F.col("lam")).otherwise(F.col("lo"))) \
             .withColumn("hi", F.when(err > 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - F.try_divide(err, F.col("slope"))
        mid = (F.col("lo") + F.col("hi")) / 2
        done = (F.abs(err) <= tol * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("source_size") == 0)
        nxt = F.when(done, F.col("lam")).when((F.col("slope") > 0) & (step >= F.col("lo")) & (step <= F.col("hi")), step).otherwise(mid)
        x = cut(x.withColumn("off", ~done).withColumn("lam", nxt).drop("got", "slope"), "mix-dual")
        if not x.where("off").limit(1).count():
            return x.drop("off")
        st = x.drop("off")
    return st


def mix(docs: DataFrame, source_col="source", text_col="text", weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0,
        keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) plus __size, __source_size, __target, __copies (0..cap)."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("doc"),
                        F.col(f"`{source_col}`").alias("s"),
                        F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h")), "mix-rows")
    d = rows.select("rid", "s", "size", "h")           # copies are settled on these; the documents move once, at the end
    hist = cut(d.groupBy(F.col("s").alias("source"), "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    tot = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    tgt = targets(tot, weights, share, cap)
    dual = solve(hist, tgt, cap).select(F.col("source").alias("s2"), "lam", "mean")
    a = hist.join(tgt.select(F.col("source").alias("s1"), "source_size", "target"), F.expr("source <=> s1")).drop("s1")
    a = a.join(dual, F.expr("source <=> s2"), "left").drop("s2")
    tilted = F.exp(F.least(F.log(F.lit(cap)), F.col("lam") * F.col("size") / F.col("mean")))
    rate = F.when(F.col("lam").isNull(), 1.0).when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).otherwise(tilted)
    w = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("mass", F.col("n") * rate).withColumn("cum", F.sum("mass").over(w))
    # copies of all documents of one source and size
    a = a.withColumn("c", F.least(F.floor(F.col("cum") + 0.5 + 1e-9) - F.floor(F.col("cum") - F.col("mass") + 0.5 + 1e-9), F.lit(int(cap)) * F.col("n")))
    # a hot (source, size) is dealt over sub-groups by hash; each takes its even share
    a = a.withColumn("nb", F.ceil(F.col("n") / GROUP).cast("long"))
    a = a.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "source_size", "target", "n", "c", "nb")
    d = d.join(a, F.expr("s <=> s2 AND size = z2")).withColumn("b", F.pmod("h", F.col("nb")))
    key = ["s", "size", "b"]
    counts = d.groupBy(*key).agg(F.count(F.lit(1)).alias("nbk"), F.first("n").alias("n0"), F.first("c").alias("c0"))
    o = Window.partitionBy("s", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("cu", F.sum("nbk").over(o))
    share_to = lambda x: F.floor(x * F.col("c0") / F.col("n0"))
    counts = counts.withColumn("cb", share_to(F.col("cu")) - share_to(F.col("cu") - F.col("nbk")))
    counts = counts.select(F.col("s").alias("s3"), F.col("size").alias("z3"), F.col("b").alias("b3"), "nbk", "cb")
    d = d.join(counts, F.expr("s <=> s3 AND size = z3 AND b = b3"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("h"))
    copies = F.floor(F.col("cb") / F.col("nbk")) + (rank <= F.col("cb") % F.col("nbk")).cast("long")
    settled = d.select("rid", copies.alias("__copies"), "source_size", "target")
    return rows.select("rid", "doc", "size").join(settled, "rid").select(
        "doc.*", F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__copies")
