"""Regression, ranking and enrichment metrics as aggregates.

Undefined metrics (no variance, one class only) are null. Rows are expected to be finite:
filter them with `functions.scalars.finite`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .order import average_ranks, group_quantile, quantiles, row_numbers, running

FRACTIONS = (0.01, 0.05, 0.1)


def pearson(y: str, p: str, my: str, mp: str) -> Column:
    """Centred product over the product of the norms."""
    dy, dp = F.col(y) - F.col(my), F.col(p) - F.col(mp)
    return ratio(F.sum(dy * dp), F.sqrt(F.sum(dy * dy)) * F.sqrt(F.sum(dp * dp)))


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, r2 (against the mean), pearson, spearman, top_decile_rmse, per group or over all."""
    by = by or []
    rows = df.select(*by, F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
    ranked = average_ranks(average_ranks(rows, "y", "ry", by), "p", "rp", by)
    means = rows.groupBy(*by).agg(F.avg("y").alias("my"), F.avg("p").alias("mp"), F.count("*").alias("nn"))
    if by:
        joined = ranked.join(means.join(group_quantile(rows, "y", 0.9, by, "q9"), by), by)
    else:
        m = means.first().asDict() | {"q9": quantiles(rows, "y", [0.9])[0]}
        joined = ranked.select("*", *(F.lit(m[c]).cast("double").alias(c) for c in ("my", "mp", "nn", "q9")))
    joined = joined.withColumn("mr", (F.col("nn") - 1) / F.lit(2.0))
    err, off = F.col("p") - F.col("y"), F.col("y") - F.col("my")
    return joined.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - ratio(F.sum(err * err), F.sum(off * off))).alias("r2"),
        pearson("y", "p", "my", "mp").alias("pearson"),
        pearson("ry", "rp", "mr", "mr").alias("spearman"),
        F.sqrt(F.avg(F.when(F.col("y") >= F.col("q9"), err * err))).alias("top_decile_rmse"),
    )


def sweep(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row per distinct score, from the highest: s, tp and k so far, and the row's own tp0 and k0, with totals np and n."""
    points = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(y).cast("long")).alias("tp0"), F.count("*").alias("k0"))
    total = points.agg(F.sum("tp0").alias("np"), F.sum("k0").alias("n")).first()
    rows = running(points, "s", {"tp": "tp0", "k": "k0"}, descending=True)
    return rows.select("*", F.lit(total["np"] or 0).cast("long").alias("np"), F.lit(total["n"] or 0).cast("long").alias("n"))


def _rates(points: DataFrame) -> DataFrame:
    neg = F.col("n") - F.col("np")
    fp, fp_before = F.col("k") - F.col("tp"), F.col("k") - F.col("k0") - (F.col("tp") - F.col("tp0"))
    return points.select(
        "*", ratio(F.col("tp"), F.col("np")).alias("tpr"), ratio(F.col("tp") - F.col("tp0"), F.col("np")).alias("tpr0"), ratio(fp, neg).alias("fpr"), ratio(fp_before, neg).alias("fpr0"), ratio(F.col("tp"), F.col("k")).alias("precision")
    )


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """threshold, fpr, tpr; the first point is (inf, 0, 0)."""
    points = _rates(sweep(df, y, score)).select(F.col("s").alias("threshold"), "fpr", "tpr")
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.union(points)


def pr_points(df: DataFrame, y: str, score: str) -> DataFrame:
    return _rates(sweep(df, y, score)).select(F.col("s").alias("threshold"), F.col("tpr").alias("recall"), "precision")


def ranking_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """auroc (trapezoids between distinct scores) and average_precision (steps)."""
    r = _rates(sweep(df, y, score))
    area = (F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2
    return r.agg(F.sum(area).alias("auroc"), F.sum((F.col("tpr") - F.col("tpr0")) * F.col("precision")).alias("average_precision"))


def enrichment(df: DataFrame, y: str, score: str, row_id: str, fractions=FRACTIONS) -> DataFrame:
    """fraction, k, hits and ef: hits among the k best (at least one, half-even share; ties by row id) over what chance gives."""
    rows = row_numbers(df.select(F.col(y).cast("long").alias("y"), F.col(score).cast("double").alias("s"), F.col(row_id).alias("id")), "s", ["id"], descending=True)
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    ks = [max(1, round(f * n)) for f in fractions]
    hits = rows.agg(*(F.coalesce(F.sum(F.when(F.col("rn") <= k, F.col("y"))), F.lit(0)).alias(f"h{i}") for i, k in enumerate(ks)))
    out = F.array(*(F.struct(F.lit(float(f)).alias("fraction"), F.lit(k).cast("long").alias("k"), F.col(f"h{i}").alias("hits")) for i, (f, k) in enumerate(zip(fractions, ks, strict=True))))
    table = hits.select(F.explode(out).alias("e")).select("e.*")
    return table.withColumn("ef", ratio(ratio(F.col("hits"), F.col("k")), ratio(F.lit(positive or 0), F.lit(n or 0))))


def binary_metrics(df: DataFrame, y: str, score: str, row_id: str) -> DataFrame:
    """n, n_positive, hit_rate, auroc, average_precision and ef_top_<fraction>."""
    base = df.agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("n_positive"), F.avg(F.col(y).cast("double")).alias("hit_rate")).first()
    ef = {x["fraction"]: x["ef"] for x in enrichment(df, y, score, row_id).collect()}
    consts = [F.lit(base[c]).alias(c) for c in ("n", "n_positive", "hit_rate")]
    tops = [F.lit(ef[f]).cast("double").alias(f"ef_top_{f}") for f in FRACTIONS]
    return ranking_metrics(df, y, score).select(*consts, "auroc", "average_precision", *tops)
