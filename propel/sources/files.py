"""File sources and sinks.

Readers take explicit schemas; writers are plain DataFrameWriter calls. The
header-block rating text is read in parallel: every input split is labelled
on its own as it is read, and a header that sits in an earlier split is carried forward
through a table with one row per split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITLE_SEP = "\u0001"  # a separator absent from the data: every line is one field
LATIN1 = "ISO-8859-1"


# ---- header-block rating text ------------------------------------------------------
def rating_block_lines(ratings: DataFrame, salts: int = 1) -> DataFrame:
    """Ratings as header-block lines (``movie_id:`` then ``user,rating,date``).

    With ``salts`` > 1 a movie's ratings are cut into that many blocks (by a
    hash of the user), each with its own header, so one very popular movie is
    written by several tasks; readers see ordinary repeated blocks."""
    r = ratings.withColumn("_s", (F.xxhash64("user_id") % salts + salts) % salts if salts > 1 else F.lit(0))
    heads = r.select("movie_id", "_s").distinct().select(
        "movie_id", "_s", F.lit(0).alias("_k"), F.lit(None).cast("bigint").alias("_u"),
        F.lit(None).cast("timestamp").alias("_d"), F.concat(F.col("movie_id").cast("string"), F.lit(":")).alias("value"))
    rows = r.select(
        "movie_id", "_s", F.lit(1).alias("_k"), F.col("user_id").cast("bigint").alias("_u"), F.col("date").alias("_d"),
        F.concat_ws(",", F.col("user_id").cast("string"), F.col("rating").cast("string"),
                    F.date_format("date", "yyyy-MM-dd")).alias("value"))
    return heads.unionByName(rows)


def write_rating_blocks(ratings: DataFrame, path: str, files: int = 4, salts: int = 1,
                        rows_per_file: int = 1_000_000) -> str:
    """Write blocks to ``files`` text files, or to more of about ``rows_per_file`` ratings (a
    task sorts one file); each (movie, salt) block lives in one file."""
    files = max(files, -(-ratings.count() // rows_per_file))
    lines = rating_block_lines(ratings, salts)
    (lines.repartition(files, "movie_id", "_s").sortWithinPartitions("movie_id", "_s", "_k", "_u", "_d")
     .select("value").write.mode("overwrite").text(path))
    return path


def _fill_headers(batches):
    """Rating lines with the header in force inside their split (null before its first one);
    the lines of a split come in order."""
    at, last = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, split = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.append(at != (file[0], split[0]), (file[1:] != file[:-1]) | (split[1:] != split[:-1]))
        is_head = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        heads = batch.column(2).fill_null(0).to_numpy()
        pos = np.maximum.accumulate(np.where(new | is_head, np.arange(n), -1))
        known = np.where(pos >= 0, is_head[pos], last is not None)
        value = np.where(pos >= 0, heads[pos], last or 0)
        at, last = (file[-1], split[-1]), int(value[-1]) if known[-1] else None
        filled = pa.array(value, pa.int64(), mask=~known)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], filled, *batch.columns[4:]],
                                         ["_file", "_split", "_in_split", "user_id", "rating", "date"]).filter(batch.column(3))


def read_rating_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, movie_id, rating, date) from header-block text.

    Skips blank lines, lines that are not 3 fields and lines whose numbers do
    not parse. Lines before the first header of a file get a NULL movie_id
    (the header state resets per file). Lines are not shuffled: each task fills
    headers forward as it reads, and one row per split carries them over.
    """
    s = F.trim("value")
    head = F.when(s.endswith(":"), F.regexp_extract(s, r"^(.*):$", 1).try_cast("bigint"))
    parts = F.split(s, ",", -1)
    x = spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        head.alias("_head"), F.monotonically_increasing_id().alias("_rid"), F.size(parts).alias("_n"),
        F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("user_id"),
        F.try_element_at(parts, F.lit(2)).try_cast("int").alias("rating"),
        F.try_to_timestamp(F.trim(F.try_element_at(parts, F.lit(3))), F.lit("yyyy-MM-dd")).alias("date"))
    # last header of each split, carried to later splits of the same file (one row per split)
    last = x.groupBy("_file", "_split").agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("_rid"))).alias("_last"))
    ws = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("_file", "_split", F.last("_last", ignorenulls=True).over(ws).alias("_carry"))
    use = (F.col("_head").isNull() & (F.col("_n") == 3) & F.col("user_id").isNotNull() & F.col("rating").isNotNull()
           & F.col("date").isNotNull())
    rows = x.select("_file", "_split", "_head", use.alias("_use"), "user_id", "rating", "date").mapInArrow(
        _fill_headers, "_file long, _split long, _in_split long, user_id long, rating int, date timestamp")
    return rows.join(F.broadcast(carry), ["_file", "_split"], "left").select(
        "user_id", F.coalesce("_in_split", "_carry").alias("movie_id"), "rating", "date")


def read_block_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


# ---- delimited titles -------------------------------------------------------------
def write_titles(movies: DataFrame, path: str) -> str:
    """``id,year,title`` lines, Latin-1, no header; missing year written as NULL."""
    line = F.concat_ws(",", F.col("movie_id").cast("string"), F.coalesce(F.col("year").cast("string"), F.lit("NULL")),
                       F.col("title"))
    (movies.select(line.alias("line")).write.mode("overwrite")
     .option("encoding", LATIN1).option("sep", TITLE_SEP).option("quote", "").option("escape", "")
     .csv(path))
    return path


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(movie_id, year, title): the title keeps any further commas."""
    raw = (spark.read.schema("line string").option("encoding", LATIN1).option("sep", TITLE_SEP)
           .option("quote", "").option("escape", "").csv(path))
    raw = raw.where(F.col("line").isNotNull() & (F.trim("line") != ""))
    parts = F.split("line", ",", 3)
    return raw.select(F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("movie_id"),
                      F.try_element_at(parts, F.lit(2)).try_cast("int").alias("year"),
                      F.try_element_at(parts, F.lit(3)).alias("title"))


# ---- typed CSV, parquet features, JSON columns ----------------------------------------
def write_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True)
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_parquet_features(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Feature parquet with a declared schema; a missing path gives an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def parse_json_column(df: DataFrame, col: str, schema: str) -> DataFrame:
    """JSON text -> typed column ``<col>_parsed`` (struct/map/array per schema)."""
    return df.withColumn(f"{col}_parsed", F.from_json(F.col(col), schema))


def append_with_server_time(df: DataFrame, path: str, ts_col: str = "logged_at") -> str:
    """Append rows stamped with the write time (the server timestamp of a log insert)."""
    df.withColumn(ts_col, F.current_timestamp()).write.mode("append").parquet(path)
    return path
