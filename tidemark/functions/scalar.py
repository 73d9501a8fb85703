"""Column expressions that the operators share."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(alpha: float) -> float:
    """Quantile of the normal distribution for an upper tail of alpha; infinite at 0 and 1."""
    if alpha <= 0 or alpha >= 1:
        return float("inf") if alpha <= 0 else float("-inf")
    return NormalDist().inv_cdf(1 - alpha)


def finite(x: Column) -> Column:
    """Null for NaN and infinities: NaN would be above any threshold."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    v = doubles(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))
