"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query assumes. Time arithmetic follows UTC; AQE re-plans
# shuffles at runtime (coalescing small partitions, splitting skewed joins).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "propel", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's session and call
    :func:`ensure_conf` instead."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("PROPEL_DRIVER_MEM", "4g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024)))
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Pin the settings on an existing session; a session that refuses UTC raises, since
    every result depends on it."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession, name: str = "") -> str:
    """A folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only when the session names none (local tests) a scratch folder is created
    and registered as the checkpoint dir, so ``DataFrame.checkpoint()`` works too.
    """
    sc = spark.sparkContext
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or sc.getConf().get("spark.checkpoint.dir", None)
            or sc.getCheckpointDir())
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="propel-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # core conf may be read-only at runtime
            pass
        sc.setCheckpointDir(base)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    if not name:
        return base
    return base.rstrip("/") + "/" + name


def unique_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of :func:`shared_dir` for one run (never reused)."""
    import uuid
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, how: str = "checkpoint"):
    """Cut lineage at ``df``, which feeds several later passes: a reliable ``checkpoint()``
    or a parquet table (``how="table"``) in the shared folder, at every input size. Both
    survive executor loss, unlike a local checkpoint."""
    spark = df.sparkSession
    if how == "checkpoint":
        shared_dir(spark)
        return df.checkpoint(eager=True)
    path = unique_dir(spark, "mat")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def size_for_input(spark: SparkSession, input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20,
                   max_split_bytes: int = 256 << 20) -> dict:
    """Shuffle sizing for a given input volume, so partitions fit executor memory.

    Initial shuffle partitions = input / target (at least 2 per core); AQE then
    coalesces toward the advisory size and splits skewed partitions. Scan splits
    are capped at ``max_split_bytes``. Returns the settings it applied.
    """
    parts = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(max_split_bytes),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
