"""Imbalance of a target and weights against it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import equal_width_bin
from .order import quantiles

#: Bins, the cap of a weight, cells of the density grid, and what counts as imbalanced, small or discrete.
BINS, MAX_WEIGHT, GRID = 20, 10.0, 512
CV_LIMIT, EMPTY_LIMIT, FEW_ROWS, FEW_VALUES = 0.5, 0.3, 1000, 20


def ends(df: DataFrame, y: str) -> tuple[float, float]:
    """The 1st and 99th percentile; zeros for an empty table."""
    lo, hi = quantiles(df, y, [0.01, 0.99])
    return (lo, hi) if lo is not None else (0.0, 0.0)


def value_bins(df: DataFrame, y: str, n_bins: int = BINS, bounds: tuple[float, float] | None = None) -> DataFrame:
    """bin, count over equal widths between the 1st and 99th percentile; all bins, the empty ones too."""
    lo, hi = bounds or ends(df, y)
    found = df.groupBy(equal_width_bin(F.col(y), lo, hi, n_bins).alias("bin")).agg(F.count("*").alias("count")) if hi > lo else df.groupBy(F.lit(0).alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def imbalance(df: DataFrame, y: str, n_bins: int = BINS) -> DataFrame:
    """cv of the counts of non-empty bins, share of empty bins, and whether the target is imbalanced; never for a constant target."""
    full = F.when(F.col("count") > 0, F.col("count"))
    found = value_bins(df, y, n_bins).agg((F.stddev_pop(full) / F.avg(full)).alias("cv"), F.avg((F.col("count") == 0).cast("double")).alias("empty_share"))
    lo, hi = df.agg(F.min(y), F.max(y)).first()
    varied = lo is not None and hi - lo > 1e-12
    return found.select("cv", "empty_share", (((F.col("cv") > CV_LIMIT) | (F.col("empty_share") > EMPTY_LIMIT)) & F.lit(varied)).alias("imbalanced"))


def bin_weights(df: DataFrame, y: str, n_bins: int = BINS, cap: float = MAX_WEIGHT, bounds: tuple[float, float] | None = None) -> DataFrame:
    """bin, count, weight: rows per bin if even, over the bin's rows, between 1 and the cap; 1 for an empty bin."""
    bins = value_bins(df, y, n_bins, bounds)
    n = df.count()
    even = F.lit(float(n)) / (F.lit(float(n_bins)) * F.col("count"))
    return bins.select("bin", "count", F.when(F.col("count") > 0, F.least(F.greatest(even, F.lit(1.0)), F.lit(cap))).otherwise(F.lit(1.0)).alias("weight"))


def apply_bin_weights(df: DataFrame, y: str, n_bins: int = BINS) -> DataFrame:
    """df with bin and weight; the table of weights has n_bins rows."""
    lo, hi = ends(df, y)
    table = bin_weights(df, y, n_bins, bounds=(lo, hi)).select("bin", "weight")
    return df.withColumn("bin", equal_width_bin(F.col(y), lo, hi, n_bins)).join(F.broadcast(table), "bin", "left")


def density_weights(df: DataFrame, y: str, alpha: float = 1.0, cap: float = MAX_WEIGHT, cells: int = GRID) -> DataFrame:
    """cell, count, density, weight over a fine grid from the least to the largest value.

    The counts are smoothed with a Gaussian of Silverman's bandwidth cut at three of them;
    a weight is what a typical row's density is to the cell's.
    """
    v = F.col(y).cast("double")
    s = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_pop(v).alias("sd"), F.count("*").alias("n")).first()
    if s["lo"] is None or s["hi"] - s["lo"] < 1e-12:
        return df.agg(F.lit(0).alias("cell"), F.count("*").alias("count"), F.lit(1.0).alias("density"), F.lit(1.0).alias("weight"))
    quarter, three = quantiles(df, y, [0.25, 0.75])
    dx, iqr = (s["hi"] - s["lo"]) / cells, three - quarter
    scale = min(s["sd"], iqr / 1.349) if iqr > 0 else s["sd"]
    width = max(0.9 * scale * s["n"] ** -0.2, dx)
    half = max(int(3 * width / dx), 1)
    norm = sum(math.exp(-0.5 * (j * dx / width) ** 2) for j in range(-half, half + 1))
    cell: Column = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((v - F.lit(s["lo"])) / F.lit(dx)).cast("int")))
    counts = df.groupBy(cell.alias("c")).agg(F.count("*").alias("m"))
    # a row of counts reaches the cells within the kernel: at most cells * (2 half + 1) rows, whatever the input
    reach = counts.select("m", "c", F.explode(F.sequence(F.greatest(F.col("c") - half, F.lit(0)), F.least(F.col("c") + half, F.lit(cells - 1)))).alias("cell"))
    kernel = F.exp(F.lit(-0.5) * F.pow((F.col("cell") - F.col("c")) * F.lit(dx) / F.lit(width), 2)) / F.lit(norm)
    smooth = reach.groupBy("cell").agg(F.sum(F.col("m") * kernel).alias("d"), F.max(F.when(F.col("c") == F.col("cell"), F.col("m"))).alias("m"))
    every = df.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    grid = every.join(smooth, "cell", "left").select("cell", F.coalesce("m", F.lit(0)).alias("count"), F.coalesce("d", F.lit(0.0)).alias("d"))
    top = grid.agg(F.max("d")).first()[0]
    grid = grid.select("cell", "count", F.greatest("d", F.lit(top * 1e-6)).alias("density"))
    typical = grid.agg(F.sum(F.col("density") * F.col("count")) / F.sum("count")).first()[0]
    return grid.withColumn("weight", F.least(F.greatest(F.pow(F.lit(typical) / F.col("density"), F.lit(alpha)), F.lit(1.0)), F.lit(cap)))


def strategy(df: DataFrame, y: str, mode: str = "auto") -> dict:
    """Which weighting a target gets: none, bins or kde, and why; modes auto, on, off, none, kde, bins."""
    if mode in ("off", "none"):
        return {"strategy": "none", "reason": f"mode {mode}"}
    if mode in ("kde", "bins"):
        return {"strategy": mode, "reason": f"mode {mode}"}
    if mode not in ("auto", "on"):
        raise ValueError(f"no such weighting mode: {mode}")
    n, values = df.agg(F.count("*"), F.countDistinct(y)).first()
    found = imbalance(df, y).first()
    info = {"n": n, "n_unique": values, "cv": found["cv"], "imbalanced": bool(found["imbalanced"])}
    if mode == "auto" and not info["imbalanced"]:
        return {"strategy": "none", **info}
    return {"strategy": "bins" if n < FEW_ROWS or values < FEW_VALUES else "kde", **info}
