"""Running sums, ranks, row numbers and quantiles over a whole table without a single-task window.

Values are dealt to parts by cut points (approximate quantiles), a window runs inside each
part, and the totals of the parts before are added from a table of one row per part (and
group). Rows are numbered through a range partitioning by value and ties together, so that
a value that most rows share is split as well. Parts are as many as the session's shuffle
partitions, a setting that has to be raised with the data.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def n_parts(df: DataFrame) -> int:
    """The session's shuffle partitions, between 8 and 2000 (what approximate quantiles can tell apart)."""
    return max(8, min(2000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, value: str, parts: int) -> list[float]:
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"]
    return sorted({x for x in found or [] if x - x == 0})


def with_part(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """df with _part: the number of cut points up to the value; nulls are in the last part."""
    if not cuts:
        return df.withColumn("_part", F.lit(0))
    splits = [-float("inf"), *cuts, float("inf")]
    deal = Bucketizer(splits=splits, inputCol="_value", outputCol="_at", handleInvalid="keep")
    placed = deal.transform(df.withColumn("_value", F.coalesce(F.col(value).cast("double"), F.lit(float("inf")))))
    return placed.withColumn("_part", F.col("_at").cast("int")).drop("_value", "_at")


def running(df: DataFrame, value: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df, one row per value (and group), with sums (new column: summed column) over all rows up to each row in the order of value, per group `by`."""
    by = by or []
    placed = with_part(df, value, cut_points(df, value, n_parts(df)))
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*by, "_part").orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, 0)
    before = (Window.partitionBy(*by) if by else Window).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    base = totals.select(*by, "_part", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    own = placed.select("*", *(F.sum(c).over(inside).alias(k) for k, c in sums.items()))
    joined = own.join(base if by else F.broadcast(base), [*by, "_part"])  # without groups: a row a part
    return joined.select(*df.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))


def row_numbers(df: DataFrame, value: str, ties: list[str], out: str = "rn", descending: bool = False) -> DataFrame:
    """1-based numbers in the order of value, then ties.

    Rows are range-partitioned, sorted and written once; a row's number is its place in its
    partition and the rows of those before. The table is deleted when the session's driver ends.
    """
    spark, keys = df.sparkSession, [F.col(value).desc() if descending else F.col(value).asc(), *ties]
    ranged = df.repartitionByRange(n_parts(df), *keys).sortWithinPartitions(*keys)
    path = shared_folder(spark, "numbered")
    ranged.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_place")).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(base), "_part").select(*df.columns, (F.col("_base") + F.col("_place") + 1).alias(out))


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with 0-based ranks; equal values share the mean of their ranks."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ends = running(counts, value, {"_end": "_n"}, by)
    ranks = ends.select(*by, value, (F.col("_end") - F.col("_n") + (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*by, value])


def _ends(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    return running(counts, "v", {"end": "n"}, by)


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, from counts of distinct values and running sums.

    No task holds the distinct values of the whole column; the two neighbours of each place come to the driver.
    """
    ends = _ends(df, value, [])
    total = df.where(F.col(value).isNotNull()).count()
    if not total:
        return [None] * len(shares)
    at = [q * (total - 1) for q in shares]
    asked = sorted({k for x in at for k in (int(x), min(int(x) + 1, total - 1))})
    hit = F.filter(F.array(*(F.lit(k).cast("long") for k in asked)), lambda k: (k < F.col("end")) & (k >= F.col("end") - F.col("n")))
    found = {r["k"]: r["v"] for r in ends.select("v", F.explode(hit).alias("k")).collect()}
    return [found[int(x)] + (x - int(x)) * (found[min(int(x) + 1, total - 1)] - found[int(x)]) for x in at]


def group_quantile(df: DataFrame, value: str, share: float, by: list[str], out: str) -> DataFrame:
    """by and the exact quantile of each group, by the same counts and running sums: a group of any size is in no single task."""
    totals = df.where(F.col(value).isNotNull()).groupBy(*by).agg((F.lit(share) * (F.count("*") - 1)).alias("_at"))
    ends = _ends(df, value, by).join(totals, by)
    at, first = F.col("_at"), F.floor("_at")
    holds = lambda k: (k < F.col("end")) & (k >= F.col("end") - F.col("n"))
    low, high = F.max(F.when(holds(first), F.col("v"))), F.max(F.when(holds(F.ceil("_at")), F.col("v")))
    found = ends.groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.first(at - first).alias("_part"))
    return found.select(*by, (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias(out))
