"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: White space as the operators' word rule has it: `[^\x20\x09-\x0D]+` is a word.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where it is unset, a local session (tests, the bench) gets a temporary folder;
    a cluster session without it is an error, since its machines share no folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


#: The tables that are cut, of each function that tidies up and is running, innermost last.
_SCOPES: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return the table: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(table: DataFrame) -> DataFrame:
    """table, after the shuffle files of what was run before it are given up: Spark deletes them when the driver's garbage is collected, which a small heap may put off for long."""
    gc.collect()
    table.sparkSession._jvm.System.gc()
    return table


def free(spark: SparkSession, paths: list[str], unless_read_by: tuple = ()) -> list[str]:
    """Delete tables that none of some DataFrames reads; returns the others."""
    files = [f for x in unless_read_by if isinstance(x, DataFrame) for f in x.inputFiles()]
    left = []
    for path in paths:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            left.append(path)
        else:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return left


@contextmanager
def scope():
    """The paths of the tables that are cut inside."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def tidy(f):
    """f, whose first argument is a DataFrame, with the tables deleted that it cuts and that what it returns does not read."""

    @wraps(f)
    def run(df: DataFrame, *args, **options):
        with scope() as paths:
            found = f(df, *args, **options)
        left = free(df.sparkSession, paths, found if isinstance(found, tuple) else (found,))
        if _SCOPES:
            _SCOPES[-1].extend(left)
        return found

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def held(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def _bytes(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(column) * 8, F.lit(0)) + 24
    return F.coalesce(F.octet_length(column), F.lit(0)) + 16 if isinstance(kind, (StringType, BinaryType)) else F.lit(8 * len(kind) if isinstance(kind, StructType) else 8)


def small(table: DataFrame, most: int = 64 << 20) -> DataFrame:
    """table, marked for broadcast if its values take at most so many bytes (it should be cut: they are added up); else it is joined by a shuffle."""
    size = sum((_bytes(F.col(f.name), f.dataType) for f in table.schema.fields), F.lit(8))
    return F.broadcast(table) if (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else table


def whole_row(docs: DataFrame, **named: str) -> DataFrame:
    """A struct `row` of all columns of docs, and the named ones beside it, so that no name clashes."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.col(f"`{c}`").alias(k) for k, c in named.items()))


def unpacked(rows: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `like` out of the struct `row`, some of them changed."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in like.columns))
