"""Running the stream forms: file sources, availableNow runs and foreachBatch sinks.

Checkpoints live under the session's shared ``spark.checkpoint.dir``; every
sink below is idempotent per micro-batch (epoch-keyed partition overwrite),
so a retried batch after an executor loss writes the same rows once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propel.functions.prefix import running_sums
from propel.session import unique_dir


def stage_files(df: DataFrame, path: str, order_col: str, parts: int = 4,
                rows_per_file: int = 1_000_000) -> tuple[str, int]:
    """Write rows as ``parts`` time ranges of ``order_col``, one write per range in
    time order, each as exactly k files (round-robin, so none is empty). A file
    stream that takes k files per trigger then replays one range per micro-batch.
    Returns (path, k). The ranges are written by parallel tasks; no single task
    carries a range."""
    us_col = F.unix_micros(F.col(order_col).cast("timestamp"))
    # parts - 1 cut points and the row count: bounded driver-side values
    edges, n = df.select(F.percentile_approx(us_col, [i / parts for i in range(1, parts)], 10000).alias("e"),
                         F.count(F.lit(1)).alias("n")).first()
    k = max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // (parts * rows_per_file) or 1))
    bounds = [None] + list(edges) + [None]
    for i in range(parts):
        cond = F.lit(True)
        if bounds[i] is not None:
            cond = cond & (us_col > bounds[i])
        if bounds[i + 1] is not None:
            cond = cond & (us_col <= bounds[i + 1])
        df.where(cond).repartition(k).write.mode("append").parquet(path)
    return path, k


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available_now(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
                      sink_path: str | None = None,
                      foreach_batch: Callable[[DataFrame, int], None] | None = None) -> str:
    """Process everything available, then stop. Returns the sink path."""
    ckpt = unique_dir(spark, f"ckpt-{name}")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        sink_path = sink_path or unique_dir(spark, f"sink-{name}")
        q = w.format("parquet").option("path", sink_path).start()
    q.awaitTermination()
    return sink_path or ""


def feedback_stream_trigger(spark: SparkSession, stream: DataFrame, out_path: str, threshold: int = 10,
                            order: tuple[str, str] = ("created_at", "id")) -> str:
    """Running feedback count over the stream; rows from the threshold-th on carry
    the retrain signal.

    Each micro-batch numbers its rows with the distributed running sum, offset
    by the total after the previous epoch, which is read from a one-row-per-epoch
    totals table (``<out>/_totals``), so the cost per batch does not grow with
    the history. Rows and the total overwrite their own ``epoch=`` partitions,
    so a replayed epoch rewrites the same rows.
    """
    totals_path = out_path.rstrip("/") + "_totals"

    def process(batch: DataFrame, epoch_id: int):
        at = spark._jvm.org.apache.hadoop.fs.Path(totals_path)
        prev = 0
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):  # else: first epoch
            last = (spark.read.parquet(totals_path).where(F.col("epoch") < epoch_id)
                    .agg(F.max_by("total", "epoch")).first()[0])
            prev = int(last or 0)
        b = batch.select(*order).withColumn("_one", F.lit(1).cast("long"))
        r = running_sums(b, list(order), ["_one"])
        out = (r.withColumn("running_count", F.col("cum__one") + F.lit(prev))
               .withColumn("retrain_triggered", F.col("running_count") >= threshold)
               .drop("_one", "cum__one").withColumn("epoch", F.lit(epoch_id)))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(out_path))
        n = spark.read.parquet(out_path).where(F.col("epoch") == epoch_id).count()  # this epoch only
        (spark.createDataFrame([(epoch_id, prev + n)], "epoch long, total long").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(totals_path))
    run_available_now(stream, spark, "feedback-trigger", foreach_batch=process)
    return out_path


def live_prediction_feed(spark: SparkSession, stream: DataFrame, latest_path: str, key: str = "customer_id",
                         order: tuple[str, str] = ("created_at", "id"),
                         cols: tuple[str, ...] = ("propensity_score", "model_version", "created_at", "id")) -> str:
    """Latest score per customer as an append-only table of per-epoch deltas.

    Each micro-batch writes only its changed keys (reduced with ``max_by``) into
    its own ``epoch=`` partition, so the work per batch is the batch, not the
    table. :func:`read_latest` reduces the deltas with the same ``max_by``, and
    :func:`compact_latest` folds them into one partition when they pile up.
    """
    upd = stream.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))

    def process(batch: DataFrame, epoch_id: int):
        cur = batch.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]).withColumn("epoch", F.lit(epoch_id))
        (cur.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(latest_path))
    run_available_now(upd, spark, "live-feed", mode="update", foreach_batch=process)
    return latest_path


def read_latest(spark: SparkSession, path: str, key: str = "customer_id",
                order: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """Newest row per key over all delta partitions (partial aggregation, no sort)."""
    t = spark.read.parquet(path).drop("epoch")
    cols = [c for c in t.columns if c != key]
    g = t.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def compact_latest(spark: SparkSession, path: str, out_path: str, key: str = "customer_id") -> str:
    """Fold the deltas into one table (epoch 0) at ``out_path``."""
    read_latest(spark, path, key).withColumn("epoch", F.lit(0)).write.mode("overwrite").partitionBy(
        "epoch").parquet(out_path)
    return out_path


def stream_log_append(spark: SparkSession, stream: DataFrame, path: str, ts_col: str = "logged_at",
                      name: str = "log-append") -> str:
    """Streaming variant of the log append: every row stamped with the write time,
    appended to a parquet table (the file sink is exactly-once per batch)."""
    stamped = stream.withColumn(ts_col, F.current_timestamp())
    return run_available_now(stamped, spark, name, sink_path=path)
