"""Score functions of one number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rounded(x: Column, places: int) -> Column:
    """x to so many places, halves away from zero, in double arithmetic: round() of a double goes through a decimal, which in
    a chain of many costs more than all else. From 10^6 on, or from where doubles have no such places left, by round()."""
    unit = F.lit(float(10**places))
    return F.when(F.abs(x) < min(1e6, 2.0**53 / 10**places), F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit).otherwise(F.round(x, places))


def double_band(x: Column, p1: Column, p5: Column, p95: Column, p99: Column) -> Column:
    """1 in [p5, p95], falling to .3 at p1 and p99, and to 0 at the same slope beyond."""
    low, high = F.greatest(F.lit(1e-6), p5 - p1), F.greatest(F.lit(1e-6), p99 - p95)
    return (
        F.when((x >= p5) & (x <= p95), 1.0)
        .when((x < p5) & (x >= p1), 0.3 + 0.7 * (x - p1) / low)
        .when(x < p5, F.greatest(F.lit(0.0), 0.3 - 0.3 * (p1 - x) / low))
        .when(x <= p99, 0.3 + 0.7 * (p99 - x) / high)
        .otherwise(F.greatest(F.lit(0.0), 0.3 - 0.3 * (x - p99) / high))
    )


def density_type(mean: Column, std: Column, of: Callable[[str], Column] = F.lit) -> Column:
    """Coarse class of a mask's mean and spread, or what `of` gives for it; null between the classes."""
    return (
        F.when((mean < 0.33) & (std < 0.1), of("a_fatty"))
        .when((mean < 0.45) & (std < 0.12), of("b_scattered"))
        .when((std >= 0.16) & (mean >= 0.55), of("d_extreme"))
        .when((std >= 0.14) | (mean >= 0.55), of("c_hetero"))
    )


def source_quality_score() -> Column:
    """From area_frac, circularity, convex_defect, aspect, bg_count, bg_frac, dots."""
    c = F.col
    return c("area_frac") * 1.2 + c("circularity") * 0.35 - c("convex_defect") * 0.45 - F.abs(c("aspect") - 1.55) * 0.08 - (c("bg_count") * 0.18 + c("bg_frac") * 60.0) - F.greatest(F.lit(0), c("dots") - 3) * 0.06


def artifact_burden() -> Column:
    """Whether a source is likely to imprint artifacts. Unknown texture counts as fine."""
    c = F.col
    low_texture = F.coalesce((c("lap_p75") < 14) | (c("grad_p75") < 14), F.lit(False)) & c("lap_p75").isNotNull() & c("grad_p75").isNotNull()
    return (c("marker_score") >= 8) | (c("bg_count") >= 20) | (c("bg_frac") >= 0.018) | (c("dots") >= 10) | low_texture | (c("mass_count") > 0) | (c("cluster_count") > 0) | (c("calc_dots") >= 6)
