"""Registry of keyed queries: each key is a Spark plan over the driver's tables
plus (where SQL can say it) the DuckDB oracle that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propel.plans.sql_views import with_views
from propel.session import ensure_conf
from propel.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Reference instants (FIXTURES.md): customer features and event-based tables.
AS_OF_CUSTOMER = "2001-12-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


def finish(df: DataFrame, places: int = 6) -> DataFrame:
    """Stable output: doubles rounded, timestamps as 'yyyy-MM-dd HH:mm:ss' text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(key: str, sql: str | None = None, raw: bool = False, **extra_ctes: str):
    """Register ``fn(t: Tables, spark) -> DataFrame`` under ``key``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            df = fn(Tables(spark, sf_dir))
            return df if raw else finish(df)
        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = bigint_counts(with_views(sql, **extra_ctes))
        return fn
    return deco


def bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; Spark's ``count_if`` is BIGINT.
    Wrap every ``count_if(...)`` call in a BIGINT cast (matching parentheses)."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth and k < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def R(expr: str, alias: str, places: int = 6) -> str:
    """SQL side of :func:`finish` for a double column."""
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0 AS {alias}"


def TS(expr: str, alias: str) -> str:
    """SQL side of :func:`finish` for a timestamp column."""
    return f"strftime(CAST({expr} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {alias}"


def DAYS(later: str, earlier: str) -> str:
    """R1 in DuckDB."""
    return (f"CAST(floor((epoch_us(CAST({later} AS TIMESTAMP)) - epoch_us(CAST({earlier} AS TIMESTAMP)))"
            f" / 86400000000.0) AS BIGINT)")
