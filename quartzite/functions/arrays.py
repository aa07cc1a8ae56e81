"""Distances and summaries of histograms held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column, eps: float = 0.0) -> Column:
    """Divided by its sum; zeros if there is nothing to divide."""
    s = total(a) + eps
    return F.when(s <= 1e-12, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: x / s))


def _cdf_gaps(u: Column, v: Column) -> Column:
    """Struct of the running difference, the sum of its sizes, and that sum without the last bin."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("all"), F.lit(0.0).alias("inner"))
    return F.aggregate(F.zip_with(u, v, lambda x, y: x - y), start, lambda s, d: F.struct((s["run"] + d).alias("run"), (s["all"] + F.abs(s["run"] + d)).alias("all"), s["all"].alias("inner")))


def wasserstein_bins(u: Column, v: Column) -> Column:
    """Of two histograms over equal bins of [0, 1]; 1 if one is empty."""
    gaps = _cdf_gaps(normalized(u), normalized(v))
    return F.when((total(u) <= 0) | (total(v) <= 0), 1.0).otherwise(gaps["inner"] / (F.size(u) - 1))


def emd_profile(u: Column, v: Column) -> Column:
    """Mean distance of the two running sums."""
    return _cdf_gaps(normalized(u, 1e-12), normalized(v, 1e-12))["all"] / F.size(u)


def entropy(a: Column) -> Column:
    """-sum p ln p over the bins that are not empty."""
    return -total(F.transform(F.filter(normalized(a), lambda p: p > 0), lambda p: p * F.log(p)))
