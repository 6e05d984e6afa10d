"""Queries of the training-data operators: QUERIES and ORACLE by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from propel.llm import centroids as ce
from propel.llm import chat_format as cf
from propel.llm import decontaminate as dc
from propel.llm import entropy_mix as em
from propel.llm import html_extract as he
from propel.llm import langid as li
from propel.llm import license_scan as ls
from propel.llm import near_dedup as nd
from propel.llm import quality_rules as qr
from propel.llm import resample as rs
from propel.llm import shard as sh
from propel.llm import token_count as tc
from propel.llm import toxicity as tx

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(key, sql):
    ORACLE[key] = sql


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_decontaminate(spark, sf_dir):
    m = dc.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return m.withColumnRenamed("id", "doc_id")


@query
def op4_hypergeometric_shards(spark, sf_dir):
    d = sh.shard_rows(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                    F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_entropy_mix(spark, sf_dir):
    d = em.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").cast("long").alias("source_size"),
                    F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"))


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    w = tx.fit(tx.training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    score = F.col("__score")
    return tx.score(docs, w, ["doc_id"]).select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@query
def op10_bottom_k_dedup(spark, sf_dir):
    return nd.near_duplicates(table(spark, sf_dir, "documents"), k=4).withColumnRenamed("id", "doc_id")


@query
def op1_chat_format(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return cf.read_back(cf.windows(c.unionByName(own)))


@query
def op3_license_scan(spark, sf_dir):
    return ls.scan(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op6_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = qr.learn(qr.labelled(docs, labels))
    d = qr.statistics(docs.select("doc_id", "text")).select("doc_id", "__stats.*").withColumn("base_failed", qr.base_failed())
    kept = F.when(F.col("base_failed"), False).otherwise(qr.verdict(rules))
    return d.select("doc_id", *qr.COUNTS, "base_failed", kept.alias("kept"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op7_token_counts(spark, sf_dir):
    keep = [F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")]
    d = tc.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep)
    return d.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op8_html_extract(spark, sf_dir):
    d = he.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return d.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op12_importance_resample(spark, sf_dir):
    d = rs.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return d.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_features", "weight", "score", "rank")])


# crc32 of a feature by its bytes: the table of 256 states is built from the polynomial
FEATURES_SQL = """{t}_words AS (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {t}),
{t}_features AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {t}_words)"""
oracle("op12_importance_resample", f"""
WITH {FEATURES_SQL.format(t="documents", id="doc_id")}, {FEATURES_SQL.format(t="benchmark", id="item_id")},
steps AS (SELECT list(list_reduce(range(0, 8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, v) ORDER BY v) AS st
          FROM range(0, 256) AS r(v)),
named AS (SELECT DISTINCT f FROM (SELECT f FROM documents_features UNION ALL SELECT f FROM benchmark_features)),
coded AS (SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT)),
          lambda a, x: xor(a >> 8, st[xor(a, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS b FROM named, steps),
s AS (SELECT b, count(*) AS s FROM documents_features JOIN coded USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM benchmark_features JOIN coded USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM s) + 10000)
      / (CAST(s + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
w AS (SELECT id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS w FROM documents_features JOIN coded USING (f) JOIN g USING (b) GROUP BY id),
d AS (SELECT id, len(documents_words.w) AS words, coalesce(n, 0) AS n, coalesce(w.w, 0) AS w,
      CAST(('0x' || substr(sha256('7:' || id), 1, 8)) AS BIGINT) AS h FROM documents_words LEFT JOIN w USING (id)),
z AS (SELECT *, w + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM z WHERE words >= 20)
SELECT id AS doc_id, CAST(n AS BIGINT) AS n_features, w AS weight, score,
       CASE WHEN r <= (SELECT count(*) FROM z WHERE words >= 20) * 25 // 100 THEN r END AS rank
FROM z LEFT JOIN r USING (id)""")


@query
def op13_va_file_clusters(spark, sf_dir):
    d = ce.cluster(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return d.select("vec_id", *[F.col(f"__{c}").alias(c) for c in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")])


def _lloyd_sql(rounds: int) -> str:
    step = """a{r} AS MATERIALIZED (SELECT id, c, dist FROM (SELECT id, c, sum((x - y) * (x - y)) AS dist FROM v JOIN c{r} USING (d) GROUP BY id, c)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, c) = 1)"""
    move = """c{n} AS MATERIALIZED (SELECT o.c, o.d, coalesce(m.y, o.y) AS y FROM c{r} o LEFT JOIN
  (SELECT c, d, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS y FROM v JOIN a{r} USING (id) GROUP BY c, d) m ON o.c = m.c AND o.d = m.d)"""
    parts = []
    for r in range(rounds):
        parts += [step.format(r=r), move.format(r=r, n=r + 1)]
    return ",\n".join([*parts, step.format(r=rounds)])


oracle("op13_va_file_clusters", f"""
WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE len(embedding) = 64
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT id, d, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e)),
c0 AS MATERIALIZED (SELECT c, d, x AS y FROM v JOIN (SELECT id, row_number() OVER (ORDER BY sha256('3:' || id)) - 1 AS c FROM e QUALIFY c < 8) USING (id)),
{_lloyd_sql(ce.ROUNDS)},
s AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{ce.ROUNDS} GROUP BY c)
SELECT id AS vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ce.ROUNDS} JOIN s USING (c)""")


@query
def op11_crf_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    d = li.predict(docs, li.fit(docs, ~held), keep=["doc_id"])
    return d.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"),
                    F.col("__n_words").alias("n_words"), F.size("__runs").cast("long").alias("n_runs"))
