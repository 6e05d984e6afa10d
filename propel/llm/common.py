"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from propel.session import unique_dir


#: tables written by :func:`cut` in this process
WRITTEN: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write once into the cluster's shared folder and read back (survives lost executors)."""
    path = unique_dir(df.sparkSession, name)
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` and the fields of a DDL string behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def release(spark, paths: list[str]) -> None:
    """Delete tables of :func:`cut`; nothing that reads them may still be to run."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
