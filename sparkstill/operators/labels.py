"""Label tables: profiles, tasks, preparation, alignment with the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.tables import shared_folder

#: A binary column needs so many rows, and so many of each class.
LEAST_ROWS, LEAST_CLASS = 4, 2


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, finite values, their range, and whether all are 0 or 1. One pass for all columns."""
    aggs = []
    for c in columns:
        ok = finite(F.col(c))
        v = F.when(ok, F.col(c).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), F.count(v).alias("n_finite"), F.min(v).alias("least"), F.max(v).alias("largest"), F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(False)).alias("is_binary")).alias(c))
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("p")).select("p.*")


def detect_task(df: DataFrame, column: str) -> str:
    """binary if every finite value is 0 or 1 and there is one, else regression."""
    return "binary" if profile(df, [column]).first()["is_binary"] else "regression"


def class_balance(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, positive, negative and whether that is enough to learn from."""
    parts = []
    for c in columns:
        v = F.when(finite(F.col(c)), F.col(c).cast("double"))
        parts.append(df.agg(F.lit(c).alias("name"), F.count(v).alias("n"), F.coalesce(F.sum((v == 1).cast("long")), F.lit(0)).alias("positive"), F.coalesce(F.sum((v == 0).cast("long")), F.lit(0)).alias("negative")))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.withColumn("enough", (F.col("n") >= LEAST_ROWS) & (F.least("positive", "negative") >= LEAST_CLASS))


def prepare_binary(df: DataFrame, library: DataFrame, key: str, column: str, task: str = "auto") -> DataFrame:
    """Rows of one label column that can be learned from: value known, library row parsed. Errors for other tasks and too few rows."""
    found = df.where(finite(F.col(column))).join(library, key).where(F.size("features") > 0).select(key, "features", F.col(column).cast("double").alias("y"))
    path = shared_folder(df.sparkSession, "prepared")  # texts are looked at once
    found.write.parquet(path)
    rows = df.sparkSession.read.schema(found.schema).parquet(path)
    found = detect_task(rows, "y")
    if task == "regression" or (task == "auto" and found == "regression"):
        raise NotImplementedError("only binary label columns can be learned")
    if found != "binary":
        raise ValueError(f"{column} has values other than 0 and 1")
    if not class_balance(rows, ["y"]).first()["enough"]:
        raise ValueError(f"{column}: too few rows or classes")
    return rows


def alignment(left: DataFrame, right: DataFrame, row_id: str, value: str) -> DataFrame:
    """n_left, n_right and the first row id where the two differ (null: none)."""
    a = left.select(row_id, F.col(value).alias("a"), F.lit(1).alias("l"))
    b = right.select(row_id, F.col(value).alias("b"), F.lit(1).alias("r"))
    both = a.join(b, row_id, "full")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("l").eqNullSafe(F.col("r"))
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.min(F.when(~same, F.col(row_id))).alias("first_mismatch"))


def assert_aligned(left: DataFrame, right: DataFrame, row_id: str, value: str) -> None:
    found = alignment(left, right, row_id, value).first()
    if found["n_left"] != found["n_right"]:
        raise ValueError(f"{found['n_left']} rows against {found['n_right']} of the library")
    if found["first_mismatch"] is not None:
        raise ValueError(f"row {found['first_mismatch']} is not that of the library")


def library_overlap(queries: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """share of the query rows (repeats count) whose key is in the library."""
    known = library.select(key).distinct().withColumn("_in", F.lit(1.0))
    return queries.select(key).join(known, key, "left").agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("share"))


def align_scores(scores: DataFrame, targets: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Scores with the target of the same row; targets may go on after them, scores of rows without a target are an error."""
    beyond = scores.join(targets.select(row_id), row_id, "left_anti").limit(1).count()
    if beyond:
        raise ValueError("there are scores of rows that have no target")
    return scores.join(targets, row_id)
