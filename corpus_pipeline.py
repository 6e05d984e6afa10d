"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propel.llm import decontaminate as dc
from propel.llm import entropy_mix as em
from propel.llm import near_dedup as nd
from propel.llm import shard as sh
from propel.llm import toxicity as tx
from propel.llm.common import WRITTEN, cut, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: rows per Arrow batch: whole texts and sets travel in them, so ten thousand would be hundreds of MB
BATCH_ROWS = 1000
#: tables that the last stage left
LEFT: list[str] = []


def small_batches(stage):
    """``stage`` with the session's rows per Arrow batch set to BATCH_ROWS. Tables that the stage
    before it left are deleted first: their output is written when the next stage starts."""
    @wraps(stage)
    def run(spark, docs, sf_dir):
        if stage is not drop_toxic.__wrapped__:
            release(spark, LEFT)
        LEFT.clear()
        first = len(WRITTEN)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        out = stage(spark, docs, sf_dir)
        LEFT.extend(WRITTEN[first:])
        return out
    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    w = tx.fit(tx.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return tx.score(docs, w).where("__score < 0.5").drop("__score")


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id (five words, 0.8). Rows are told
    apart by a number written once, as doc_ids may be null or stand in several rows."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = nd.near_duplicates(rows, id_col="__row").select(F.col("id").alias("__row"), F.col("component_id").alias("__c"))
    found = cut(found.join(rows.select("__row", "doc_id"), "__row"), "found")
    first = found.groupBy("__c").agg(F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    gone = found.join(first, "__c").where("__row <> __first").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


@small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return dc.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    d = em.mix(docs).withColumn("__i", F.explode(F.expr("array_repeat(0, CAST(__copies AS INT))")))
    return d.select(*docs.columns)


@small_batches
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uniform shuffle into 16 shards."""
    return sh.shard_rows(docs, 16)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_copies), ("decontamination", drop_benchmark),
          ("mixing", mix_sources), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{i}")
    return docs
