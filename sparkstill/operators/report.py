"""Tables behind validation figures; all are small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digitize, equal_width_bin, normal_quantile
from .order import average_ranks, quantiles, row_numbers


def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 20) -> DataFrame:
    """bin, n, mean_p, mean_y between distinct quantiles of the prediction; empty with under three edges."""
    edges = sorted({q for q in quantiles(df, p, [k / n_bins for k in range(n_bins + 1)]) if q is not None})
    rows = df if len(edges) >= 3 else df.where("false")
    return rows.groupBy(digitize(F.col(p), edges[1:-1]).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def histogram(df: DataFrame, value: Column, n_bins: int, by: list[str] | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """bin, n (and by) over equal widths of the value's range."""
    rows = df.select(*(by or []), value.cast("double").alias("v"))
    lo, hi = bounds or rows.agg(F.min("v"), F.max("v")).first()
    bin_ = equal_width_bin(F.col("v"), lo, hi, n_bins) if lo is not None and hi > lo else F.lit(0)
    return rows.groupBy(*(by or []), bin_.alias("bin")).agg(F.count("*").alias("n"))


def residual_histogram(df: DataFrame, y: str, p: str, n_bins: int = 60) -> DataFrame:
    return histogram(df, F.col(p) - F.col(y), n_bins)


def residual_moments(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.agg(F.avg(e).alias("bias"), F.stddev_pop(e).alias("sd"))


def score_by_class(df: DataFrame, y: str, score: str, n_bins: int = 49) -> DataFrame:
    """y, bin, n, density: counts over the class's total and the bin's width."""
    lo, hi = df.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    total = df.groupBy(F.col(y).alias("y")).agg(F.count("*").alias("total"))
    bins = histogram(df.withColumnRenamed(y, "y"), F.col(score), n_bins, ["y"], (lo, hi))
    return bins.join(F.broadcast(total), "y").select("y", "bin", "n", (F.col("n") / F.col("total") / F.lit((hi - lo) / n_bins)).alias("density"))


def score_distributions(df: DataFrame, a: str, b: str, n_bins: int = 59) -> DataFrame:
    """series, bin, n of two columns over shared edges."""
    lo, hi = df.agg(F.least(F.min(a), F.min(b)).cast("double"), F.greatest(F.max(a), F.max(b)).cast("double")).first()
    parts = [histogram(df, F.col(c), n_bins, None, (lo, hi)).select(F.lit(k).alias("series"), "bin", "n") for k, c in (("a", a), ("b", b))]
    return parts[0].unionByName(parts[1])


def qq_points(df: DataFrame, y: str, p: str, row_id: str) -> DataFrame:
    """id, z and theory: standardised residual and the normal quantile of its rank; none with under three rows or no spread."""
    rows = df.select(F.col(row_id).alias("id"), (F.col(p) - F.col(y)).cast("double").alias("e"))
    s = rows.agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.stddev_pop("e").alias("sd")).first()
    if s["n"] < 3 or not s["sd"]:
        return rows.where("false").select("id", F.col("e").alias("z"), F.col("e").alias("theory"))
    ranked = average_ranks(rows, "e", "rank")
    return ranked.select("id", ((F.col("e") - F.lit(s["m"])) / F.lit(s["sd"])).alias("z"), normal_quantile(F.col("rank"), F.lit(float(s["n"]))).alias("theory"))


def density_grid(df: DataFrame, x: str, y: str, n: int = 45) -> DataFrame:
    """bx, by_, n: counts over an n by n grid of rectangles (not hexagons), empty cells left out."""
    s = df.agg(F.min(x).cast("double"), F.max(x).cast("double"), F.min(y).cast("double"), F.max(y).cast("double")).first()
    return df.groupBy(equal_width_bin(F.col(x), s[0], s[1], n).alias("bx"), equal_width_bin(F.col(y), s[2], s[3], n).alias("by_")).agg(F.count("*").alias("n"))


def enrichment_sweep(df: DataFrame, y: str, score: str, row_id: str, points: int = 40) -> DataFrame:
    """k, hits, ef for fractions spaced geometrically from 0.001 to 1; distinct k only."""
    rows = row_numbers(df.select(F.col(y).cast("long").alias("y"), F.col(score).cast("double").alias("s"), F.col(row_id).alias("id")), "s", ["id"], descending=True)
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    ks = sorted({max(1, round(10 ** (-3 + 3 * i / (points - 1)) * n)) for i in range(points)})
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col("rn") <= k, F.col("y"))), F.lit(0)).alias(f"h{i}") for i, k in enumerate(ks)))
    table = sums.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{i}").alias("hits")) for i, k in enumerate(ks)))).alias("e")).select("e.*")
    return table.withColumn("ef", F.try_divide(F.col("hits") / F.col("k"), F.lit(positive / n if n else 0.0)))


def residual_density(df: DataFrame, y: str, p: str, n_bins: int = 45) -> DataFrame:
    """bx, by_, n: counts over rectangles of the prediction and its residual; empty ones are left out."""
    return density_grid(df.select(F.col(p).alias("_x"), (F.col(p) - F.col(y)).alias("_r")), "_x", "_r", n_bins)


def calibration_map(spark: SparkSession, found) -> DataFrame | None:
    """x, y: the anchors of a monotone map; None for fewer than two."""
    rows = [(float(a), float(b)) for a, b in zip(found.x, found.y, strict=True)]
    return spark.createDataFrame(rows, "x double, y double") if len(rows) > 1 else None
