"""MinHash near-duplicates: bottom-k sketches from one hash function.

1. Every text becomes its set of 64-bit shingle hashes; texts with equal sets form
   one class, so copies cost nothing further.
2. A class keeps its ``SKETCH`` smallest hashes. Inverted lists of the ``POSTED``
   smallest (two sets at 0.8 share none of them with probability 0.2**24) give overlaps.
   A class that meets others in fewer lists than a similar pair does (less
   ``SPREAD`` standard deviations) goes out. Lists of at most ``LIST`` classes pair all
   members; members of longer lists are compared with ``HUBS`` hubs of the list, the members that
   stand in the most long lists.
3. Overlap in the bottom-k of the union estimates the similarity and drops the
   clearly different; exact Jaccard over the whole sets verifies the rest.
4. Connected components by alternating large-star and small-star steps.
5. Long lists whose members are then not all in one component stay open: hubs may have
   missed links there. For the classes in open lists an exact prefix join over the whole sets
   finds every pair of different components that may reach the similarity: values in one order
   (rare first), the first values of a set down to the last one that two similar sets can have
   as their first common value, and a bound of the common part by position and sizes. In a list
   only members outside its largest component look for partners, so the members
   of a large group of near copies are never paired with each other. They are compared
   with the ``BEST`` members of that component that differ least from its common part, and,
   where that gave no link, with all that fit. The links found there complete the components.

Nulls and empty texts have no shingles and link with nothing. Repeated rows stay
rows of their own and share a component. Ids may be of any type that has an order;
rows without id never give a component its id and are kept only where no row of it has one. Extra columns are not read. Empty tables
give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propel.llm.common import cut, with_fields
from propel.llm.wordhash import WHITE, iter_words, shingles

SKETCH, POSTED, LIST, HUBS, BEST = 64, 24, 12, 2, 2
#: standard deviations of a sketch estimate that candidates may fall short by
SPREAD = 5


def _set_batches(k: int):
    def run(batches):
        for b in batches:
            ids, n_, keys, sk = b.column(0), [], [], []
            for _, rows, h, bd in iter_words(b.column(1), WHITE):
                for i in range(rows):
                    s = np.unique(shingles(h[bd[i]:bd[i + 1]], k))
                    n_.append(len(s))
                    keys.append(class_key(s))
                    sk.append(s[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, b.column(2), pa.array(n_, pa.int64()), pa.array(keys, pa.int64()), pa.array(sk, pa.list_(pa.int64()))],
                ["id", "th", "n", "key", "sketch"])
    return run


def class_key(s: np.ndarray) -> int | None:
    """64-bit fingerprint of a whole set; none for the empty set."""
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) if len(s) else None


def _gram_batches(k: int):
    def run(batches):
        for b in batches:
            keys, sets = [], []
            for _, rows, h, bd in iter_words(b.column(0), WHITE):
                for i in range(rows):
                    s = np.unique(shingles(h[bd[i]:bd[i + 1]], k))
                    keys.append(class_key(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "g"])
    return run


def text_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, th, n, key, sketch) per row of ``docs``; th is a hash of the text."""
    t = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), t.alias("t"), F.xxhash64(t).alias("th"))
    return src.mapInArrow(_set_batches(k), with_fields(src.select("id").schema, "th long, n long, key long, sketch array<long>"))


def _verify(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return run


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of classes whose sizes and union sketch allow the similarity."""
    c = classes.select("key", "n", "sketch")
    return (pairs.distinct().join(c.toDF("a", "na", "sa"), "a").join(c.toDF("b", "nb", "sb"), "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .withColumn("k", F.expr("least(size(sa), size(sb))"))
            # union sketch: the k smallest of both; SPREAD standard deviations below the limit still pass
            .withColumn("u", F.expr("slice(sort_array(array_union(sa, sb)), 1, k)"))
            .withColumn("o", F.expr("size(array_intersect(u, array_intersect(sa, sb)))"))
            .where(F.col("o") >= F.col("k") * percent / 100 - SPREAD * F.sqrt(F.col("k") * percent / 100 * (1 - percent / 100)))
            .select("a", "b"))


def list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a < b) of each inverted list ``v`` of ``rows`` (v, key, n); the lists are short."""
    lists = rows.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("m"))
    p = lists.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> "
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)), y -> struct(x.key AS a, y.key AS b))))")).alias("p"))
    return p.select("p.a", "p.b")


def lists(classes: DataFrame, percent: int) -> DataFrame:
    """(v, key, n, df): the posted values that two classes or more hold, of the classes that hold
    enough of them. A similar class shares at least ``percent`` of the posted values in expectation."""
    post = classes.select("key", "n", F.explode(F.slice("sketch", 1, POSTED)).alias("v"))
    met = cut(post.join(post.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "v"), "met")
    s, j = F.least(F.lit(float(POSTED)), F.col("n")), percent / 100
    need = F.greatest(F.lit(1.0), F.floor(s * j - SPREAD * F.sqrt(s * j * (1 - j))))
    few = met.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where(F.col("c") < need).select("key")
    return cut(met.join(few, "key", "left_anti").select("v", "key", "n", "df"), "lists")


def hub_pairs(long: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of each member of a long list with ``HUBS`` of its members, one for each
    hash class: the one that stands in the most long lists. The originals of a group of near
    copies hold its common values, so lists of one group agree on such hubs; a member
    meets each of its hubs once."""
    rows = long.select("v", "key", "n")
    rows = cut(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key"), "long")
    own = F.pmod(F.xxhash64("key", F.lit(HUBS)), F.lit(HUBS))
    hub = rows.groupBy("v").agg(F.array(*[F.min(F.when(own == j, F.struct(-F.col("c"), "key", "n"))) for j in range(HUBS)]).alias("hs"))
    near = F.filter("hs", lambda h: h["key"].isNotNull() & (h["key"] != F.col("key")) & (100 * F.least("n", h["n"]) >= percent * F.greatest("n", h["n"])))
    star = rows.join(hub, "v").select("key", F.transform(near, lambda h: h["key"]).alias("hs")).where("size(hs) > 0").distinct()
    star = star.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("hs"))).alias("hs"))      # at most POSTED * HUBS
    star = star.select("key", F.explode("hs").alias("h"))
    return star.select(F.least("key", "h").alias("a"), F.greatest("key", "h").alias("b"))


def open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (v, key, n), with their root, of the lists whose members are not yet in one component."""
    m = rows.select("v", "key", "n").join(roots, rows["key"] == roots["node"], "left").select("v", "key", "n", F.coalesce("root", "key").alias("root"))
    both = m.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("v")
    return m.join(both, "v")


def _value_batches(batches):
    """(key, root, n, v) of every value of whole sets, a block of values at a time."""
    for b in batches:
        for i in range(b.num_rows):
            s = np.frombuffer(b.column(2)[i].as_py(), np.int64)
            for at in range(0, len(s), 1 << 16):
                v = s[at:at + (1 << 16)]
                full = lambda x: pa.array(np.full(len(v), x.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([full(b.column(0)[i]), full(b.column(1)[i]), pa.array(np.full(len(v), len(s))), pa.array(v)], ["key", "root", "n", "v"])


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(v, key, n, top): the values of each class of ``sets`` (key, root, g) that may be its first
    common value with a similar class of another root, in one order of all values (rare first).
    Two sets with at least ``percent`` of their union in common have a first common value, at
    places i and k; the common part is at most n - i + 1 of the one and m - k + 1 of the
    other, and at least percent / (100 + percent) * (n + m). ``top`` is the largest partner that leaves."""
    vals = cut(sets.select("key", "root", "g").mapInArrow(_value_batches, "key long, root long, n long, v long"), "values")
    df = vals.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("df > 1")
    shared = vals.join(df.select("v", "df", (F.col("lo") < F.col("hi")).alias("mixed")), "v")
    w = Window.partitionBy("key")
    place = F.col("n") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("df", "v"))
    top = F.floor((100 + percent) * (F.col("n") - F.col("i") + 1) / percent - F.col("n") + 1e-9)
    pre = shared.withColumn("i", place).withColumn("top", top).where(F.col("mixed") & (100 * F.col("top") >= percent * F.col("n")))
    return cut(pre.select("v", "key", "n", "top"), "prefix")


def seeking(pre: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``pre`` with their root that can have a partner of another root in the list ``v``;
    ``seeks`` marks those outside the list's largest component."""
    pre = pre.join(roots, "key")
    by = pre.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("top").alias("high"))
    main = by.groupBy("v").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("k"),
                               F.min(F.struct("low", "root")).alias("low"), F.max(F.struct("high", "root")).alias("high")).where("k > 1")
    rest = by.join(main.select("v", F.col("low.root").alias("r1"), F.col("high.root").alias("r2")), "v").groupBy("v").agg(
        F.min(F.when(F.col("root") != F.col("r1"), F.col("low"))).alias("low2"), F.max(F.when(F.col("root") != F.col("r2"), F.col("high"))).alias("high2"))
    m = pre.join(main.join(rest, "v"), "v")
    low = F.when(F.col("low.root") != F.col("root"), F.col("low.low")).otherwise(F.col("low2"))
    high = F.when(F.col("high.root") != F.col("root"), F.col("high.high")).otherwise(F.col("high2"))
    m = m.where((low <= F.col("top")) & (high >= F.col("n"))).select("v", "key", "root", "n", "top", (F.col("root") != F.col("main")).alias("seeks"))
    return cut(m, "seek")


def partner_pairs(m: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """Pairs (a < b) of rows that seek with the rows they fit; with ``best``, only with so many rows
    of the list's largest component, those that leave room for the largest partners."""
    x = m.where("seeks").select("v", *[F.col(c).alias(f"x_{c}") for c in ("key", "root", "n", "top")])
    y = m
    if best:
        y = m.where("NOT seeks").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("top"), "key"))).where(F.col("r") <= best)
    y = y.select("v", "seeks", *[F.col(c).alias(f"y_{c}") for c in ("key", "root", "n", "top")])
    fits = F.expr(f"x_root <> y_root AND y_n <= x_top AND x_n <= y_top AND 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) AND (NOT seeks OR x_key < y_key)")
    return x.join(y, "v").where(fits).select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. Edges (a, b)."""
    e = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        m = both.groupBy("x").agg(F.min("y").alias("lo")).withColumn("lo", F.least("x", "lo"))
        large = both.join(m, "x").where("y > x").select(F.col("y").alias("x"), F.col("lo").alias("y")).where("x <> y").distinct()
        m = large.groupBy("x").agg(F.min("y").alias("lo"))
        e = large.join(m, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("lo").alias("y")),
                                                        F.struct("x", F.col("lo").alias("y")))).alias("p")).select("p.*").where("x <> y").distinct()
        e = cut(e, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == last:
            return e.groupBy("x").agg(F.min("y").alias("root")).withColumnRenamed("x", "node")
        last = now


def whole_sets(keys: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """(key, g): the whole sets of the classes ``keys``, from their texts, which are read again."""
    one = classes.join(keys.distinct(), "key", "left_semi").select("th").distinct()
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(text.alias("t"), F.xxhash64(text).alias("th")).join(one, "th", "left_semi").dropDuplicates(["th"]).select("t")
    return cut(texts.mapInArrow(_gram_batches(k), "key long, g binary").dropDuplicates(["key"]), "grams")


def similar(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    both = pairs.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")
    return cut(both.mapInArrow(_verify(percent), "a long, b long"), "links")


def link(classes: DataFrame, docs: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """(node, root) of the classes that have a similar one."""
    every = lists(classes, percent)
    short, long = every.where(F.col("df") <= LIST), every.where(F.col("df") > LIST)
    pairs = cut(likely(list_pairs(short, percent).unionByName(hub_pairs(long, percent)), classes, percent), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    links = similar(pairs, whole_sets(ends, classes, docs, text_col, k), percent)
    roots = cut(components(links), "roots")
    left = cut(open_rows(long, roots).groupBy("key").agg(F.first("root").alias("root")), "open")
    if left.isEmpty():
        return roots
    # what hubs did not join: first with the members nearest to a group's common part, then with all
    grams = whole_sets(left.select("key"), classes, docs, text_col, k)
    pre = prefix_rows(grams.join(left, "key"), percent)
    for best in (BEST, None):
        pairs = cut(likely(partner_pairs(seeking(pre, left), percent, best), classes, percent), "pairs")
        links = links.unionByName(similar(pairs, grams, percent))
        roots = cut(components(links), "roots")
        left = left.select("key").join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"))
        left = cut(left, "open")
    return roots


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row; ``kept`` marks the smallest id of a component."""
    sets = cut(text_sets(docs, id_col, text_col, k), "sets")
    classes = cut(sets.where("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("th").alias("th")), "classes")
    roots = link(classes, docs, text_col, k, percent)
    lab = sets.select("id", "n", "key").join(roots, sets["key"] == roots["node"], "left").withColumn("root", F.coalesce("root", "key"))
    low = lab.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("lo"))
    out = lab.join(low, "root", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("lo", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("lo", "id"), F.col("lo").isNull()).alias("kept"))
