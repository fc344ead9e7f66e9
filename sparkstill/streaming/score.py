"""Scoring of a stream: the same projection as in batch, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def score_stream(spark: SparkSession, folder: str, schema: StructType, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Score the Parquet files that arrive in a folder into another one, up to what is there; returns the query."""
    rows = spark.readStream.schema(schema).parquet(folder)
    query = score(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
