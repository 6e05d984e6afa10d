"""Versioned feature store, snapshots and the training-run log on parquet.

The store is a parquet table partitioned by ``version``; writes replace only
the partitions they touch (dynamic partition overwrite), so versions are kept
side by side. Reads prune to one version through the partition filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propel.sources.files import path_exists


def version_number(c="version"):
    """Numeric order of version labels ('v9' < 'v10'), text order as tiebreak."""
    return F.regexp_extract(F.col(c), r"(\d+)", 1).try_cast("bigint")


def feature_store_write(df: DataFrame, path: str, version: str, updated_at: str | None = None,
                        key: str = "customer_id") -> str:
    """Stamp version and updated_at and replace that version's partition only."""
    ts = F.lit(updated_at).cast("timestamp") if updated_at else F.current_timestamp()
    out = df.withColumn("updated_at", ts).withColumn("version", F.lit(version))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(path))
    return path


def latest_version(store: DataFrame) -> DataFrame:
    """One row: the highest version by its number."""
    v = store.select("version").distinct()
    return v.agg(F.max_by("version", F.struct(version_number("version"), F.col("version"))).alias("version"))


def feature_store_read(spark: SparkSession, path: str, ids: DataFrame | None = None, version: str = "latest",
                       key: str = "customer_id") -> DataFrame:
    """Rows of one version (``latest`` = highest number), one per key (newest
    updated_at), optionally only for the keys in ``ids``."""
    store = spark.read.parquet(path)
    if version == "latest":
        sel = store.join(F.broadcast(latest_version(store)), "version")  # one row: prunes partitions
    else:
        sel = store.where(F.col("version") == version)
    if ids is not None:
        sel = sel.join(ids.select(key).distinct(), key, "left_semi")
    cols = [c for c in sel.columns if c != key]
    latest = sel.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("updated_at")).alias("_r"))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def snapshot_store(spark: SparkSession, store_path: str, snap_path: str, snapshot_ts: str) -> str:
    """Copy the whole store into partition ``snapshot_ts=<ts>`` of the snapshot table."""
    s = spark.read.parquet(store_path).withColumn("snapshot_ts", F.lit(snapshot_ts))
    (s.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_ts").parquet(snap_path))
    return snap_path


def restore_snapshot(spark: SparkSession, snap_path: str, snapshot_ts: str | None = None) -> DataFrame:
    """The newest snapshot (or the named one), without the snapshot column."""
    s = spark.read.parquet(snap_path)
    if snapshot_ts is None:
        newest = s.select("snapshot_ts").distinct().agg(F.max("snapshot_ts").alias("snapshot_ts"))
        s = s.join(F.broadcast(newest), "snapshot_ts")
    else:
        s = s.where(F.col("snapshot_ts") == snapshot_ts)
    return s.drop("snapshot_ts")


# ---- training-run log ---------------------------------------------------------------
RUN_SCHEMA = ("run_id string, created_at timestamp, params map<string,string>, features array<string>, "
              "metrics map<string,double>, auc double")


def run_log_append(spark: SparkSession, path: str, run_id: str, params: dict, features: Sequence[str],
                   metrics: dict, created_at: str | None = None) -> DataFrame:
    """Record one training run as one row (append)."""
    from datetime import datetime, timezone
    ts = datetime.fromisoformat(created_at) if created_at else datetime.now(timezone.utc).replace(tzinfo=None)
    row = [(run_id, ts, {k: str(v) for k, v in params.items()}, list(features),
            {k: float(v) for k, v in metrics.items()}, float(metrics.get("auc")) if "auc" in metrics else None)]
    df = spark.createDataFrame(row, RUN_SCHEMA)
    df.write.mode("append").parquet(path)
    return df


def runs_from_metrics(metrics: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Run-log rows built from a metrics DataFrame (run_id, auc, ...) computed by Spark."""
    mcols = [c for c in metrics.columns if c != run_col]
    return metrics.select(
        F.col(run_col).cast("string").alias("run_id"), F.current_timestamp().alias("created_at"),
        F.create_map().cast("map<string,string>").alias("params"), F.array().cast("array<string>").alias("features"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in mcols]),
                          F.array(*[F.col(c).cast("double") for c in mcols])).alias("metrics"),
        F.col("auc").cast("double").alias("auc"))


def run_log_select_best(runs: DataFrame, metric: str = "auc") -> DataFrame:
    """The run with the highest metric (NULLs last, run_id as tiebreak)."""
    return runs.orderBy(F.col(metric).desc_nulls_last(), F.col("run_id")).limit(1)


def newest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path)
