"""Column functions: clipping, ramps, blends, binning, interpolation."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed values of the gate: similarity where the second head starts to count, where it counts most, and its largest share.
SIM_LO, SIM_HI, A_MAX = 0.4, 0.7, 0.66
#: Below this earned share a head is not blended in at all.
A_MIN = 0.1


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ramp(similarity: Column, a_max: float = A_MAX, lo: float = SIM_LO, hi: float = SIM_HI) -> Column:
    """0 up to lo, a_max from hi on, linear between."""
    return F.lit(a_max) * clip((similarity - F.lit(lo)) / F.lit(max(hi - lo, 1e-9)), 0.0, 1.0)


def blend(soft: Column, hard: Column, share: Column) -> Column:
    return (F.lit(1.0) - share) * soft + share * hard


def blend_ceiling(r2: Column, max_similarity: Column) -> Column:
    """The largest share a head has earned: its R² between 0 and A_MAX, none below A_MIN or where no row is similar enough."""
    earned = F.when(finite(r2), clip(r2, 0.0, A_MAX)).otherwise(F.lit(0.0))
    return F.when((earned < A_MIN) | (F.coalesce(max_similarity, F.lit(0.0)) < SIM_LO), F.lit(0.0)).otherwise(earned)


def digitize(v: Column, inner: list[float]) -> Column:
    """Number of the bin among sorted inner edges; bins are closed on the left."""
    if not inner:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in inner)), lambda e: e <= v))


def equal_width_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """Bin 0..n-1 of equal width between lo and hi; values outside are in the end bins."""
    width = (hi - lo) / n
    return F.when(v < F.lit(lo + width), 0).otherwise(F.least(F.lit(n - 1), F.floor((v - F.lit(lo)) / F.lit(width)).cast("int"))).cast("int")


def interpolate(v: Column, xs: list[float], ys: list[float], sign: int = 1) -> Column:
    """Piecewise linear between sorted anchors, constant beyond the ends, of sign * v; NaN is above all."""
    if len(xs) == 1:
        return F.lit(float(ys[0]))
    x = v * F.lit(float(sign))
    if len(xs) > 64:
        return _looked_up(x, xs, ys)
    ax, ay = (F.array(*(F.lit(float(a)) for a in z)) for z in (xs, ys))
    k = F.least(F.greatest(F.size(F.filter(ax, lambda a: a <= x)), F.lit(1)), F.lit(len(xs) - 1))
    x0, x1, y0, y1 = F.get(ax, k - 1), F.get(ax, k), F.get(ay, k - 1), F.get(ay, k)
    inside = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(x <= F.lit(float(xs[0])), F.lit(float(ys[0]))).when(x >= F.lit(float(xs[-1])), F.lit(float(ys[-1]))).otherwise(inside)


def _looked_up(x: Column, xs: list[float], ys: list[float]) -> Column:
    """The same for many anchors, by a binary search over batches: an interpreted filter over the anchors takes some 20 microseconds a row."""

    @arrow_udf("double")
    def run(found: pa.Array) -> pa.Array:
        import numpy as np

        ax, ay = np.array(xs, float), np.array(ys, float)
        v = found.fill_null(ax[0]).to_numpy(zero_copy_only=False)
        k = np.clip(np.searchsorted(ax, v, "right"), 1, len(ax) - 1)
        with np.errstate(all="ignore"):
            inside = ay[k - 1] + (ay[k] - ay[k - 1]) * (v - ax[k - 1]) / (ax[k] - ax[k - 1])
        out = np.where(v <= ax[0], ay[0], np.where((v >= ax[-1]) | np.isnan(v), ay[-1], inside))
        return pa.array(out, mask=found.is_null().to_numpy(zero_copy_only=False))

    return run(x.cast("double"))


def normal_quantile(rank: Column, n: Column) -> Column:
    """Standard normal quantile of a 0-based rank, by Winitzki's approximation of the inverse error function."""
    a = F.lit(0.147)
    x = F.lit(2.0) * (rank + F.lit(0.5)) / n - F.lit(1.0)
    log = F.log(F.greatest(F.lit(1.0) - x * x, F.lit(1e-300)))
    t = F.lit(2.0) / (F.lit(math.pi) * a) + log / F.lit(2.0)
    return F.lit(math.sqrt(2.0)) * F.signum(x) * F.sqrt(F.sqrt(t * t - log / a) - t)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
