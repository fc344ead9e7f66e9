"""Readers and writers of label tables, libraries and predictions."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import ColumnError, resolve

#: Fixed suffixes.
PARQUET, TAB, COMMA = (".parquet", ".pq"), (".tsv",), (".csv",)


def read_table(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Parquet, tab- or comma-separated by suffix; other suffixes are read as comma-separated, or refused if strict."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in PARQUET:
        return spark.read.parquet(path)
    if strict and suffix not in TAB + COMMA:
        raise ValueError(f"{path}: not a .csv, .tsv or .parquet file")
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix in TAB else ",")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows 0.. in the order of the files: by path, then by place in the file.

    df is a table as read (and projections of it): each block of a file is numbered inside, in
    the partition that reads it, and the rows of the blocks before, one row a block, are added.
    What is not read from files has no such order and is refused, as is a table whose rows were
    moved between partitions.
    """
    if not df.inputFiles():
        if df.isEmpty():
            return df.withColumn(name, F.monotonically_increasing_id())
        raise ValueError("rows can only be numbered as they stand in files")
    block = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    part = df.select("*", *block, F.monotonically_increasing_id().alias("_id"))
    blocks = part.groupBy("_path", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    if starts.where("_last - _first + 1 <> n").count():
        raise ValueError("rows can only be numbered as they stand in files, before a shuffle")
    joined = part.join(starts.select("_path", "_start", "_first", "_base"), ["_path", "_start"])
    return joined.select(*df.columns, (F.col("_base") + F.col("_id") - F.col("_first")).alias(name))


def read_labels(spark: SparkSession, path: str, key: str | None = None, values: list[str] | None = None) -> DataFrame:
    """row_id, key and the selected value columns as floats."""
    table = read_table(spark, path)
    name, chosen = resolve(table.columns, key, values)
    numbered = with_row_id(table)
    return numbered.select("row_id", F.col(f"`{name}`").cast("string").alias("key"), *(F.col(f"`{c}`").try_cast("float").alias(c) for c in chosen))


def read_queries(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """row_id and key of a prediction input; the column's case counts here, and the suffix must be known."""
    table = read_table(spark, path, strict=True)
    if key is not None and key not in table.columns:
        raise ColumnError(f"no column {key!r} among {table.columns}")
    name = key or resolve([*table.columns, "_"], None, [])[0]
    return with_row_id(table.select(F.col(f"`{name}`").cast("string").alias("key")))


def read_library(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The library; a limit is a predicate on row_id, which Parquet can skip row groups by."""
    rows = spark.read.parquet(path)
    return rows if limit is None else rows.where(F.col("row_id") < limit)


def write_predictions(df: DataFrame, path: str, order: str = "row_id") -> None:
    """Comma-separated with a header in the order of rows; NaN is an empty cell."""
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c != order]
    df.orderBy(order).select(*values).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    """Strict JSON (NaN and infinities become null) as a one-row text table, so that it can be kept wherever Spark writes."""
    text = json.dumps(json_safe(value), allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> int:
    """Delete a folder wherever Spark writes; returns the bytes freed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    freed = files.getContentSummary(where).getLength() if files.exists(where) else 0
    files.delete(where, True)
    return freed


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without one gets a temporary folder.

    All of a session's folders are in one folder, which is deleted when its driver ends: a table
    that a lazy result reads cannot be deleted earlier.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{base or tempfile.mkdtemp(prefix='spark-')}/session-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def json_safe(x):
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    if isinstance(x, float):
        return x if x - x == 0 else None
    return x.item() if hasattr(x, "item") else x


def build_library(spark: SparkSession, path: str, out: str, key: str | None = None, distinct: bool = False, limit: int | None = None) -> DataFrame:
    """Write a library (row_id, text) from a table: rows in the order of the files, with a text; of equal texts perhaps the first only."""
    table = read_table(spark, path)
    if key is not None and key not in table.columns:
        raise ColumnError(f"no column {key!r} among {table.columns}")
    name = key or resolve([*table.columns, "_"], None, [])[0]
    rows = with_row_id(table.select(F.col(f"`{name}`").cast("string").alias("text"))).where(F.length(F.trim("text")) > 0)
    if distinct:
        rows = rows.groupBy("text").agg(F.min("row_id").alias("row_id"))
    # numbered anew without gaps: rows are written in order, then counted as they stand in the files
    ordered = shared_folder(spark, "library")
    rows.repartitionByRange("row_id").sortWithinPartitions("row_id").select("text").write.parquet(ordered)
    numbered = with_row_id(spark.read.parquet(ordered))
    prefix = numbered if limit is None else numbered.where(F.col("row_id") < limit)
    prefix.select("row_id", "text").write.mode("errorifexists").parquet(out)
    delete(spark, ordered)
    return spark.read.parquet(out)


def export_library(spark: SparkSession, path: str, out: str, header: str = "text") -> None:
    """The library's texts in its order, comma-separated, under a header of choice."""
    read_library(spark, path).orderBy("row_id").select(F.col("text").alias(header)).write.mode("overwrite").csv(out, header=True)
