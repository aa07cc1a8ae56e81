"""Baselines, calibrated thresholds, grades, totals, tiers.

Thresholds are a table of one row, so calibration is a select and grading a join with one row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.bands import clip01, density_type, double_band, rounded
from ..functions.percentiles import counted_percentiles, few_values, wide_percentiles

#: Metrics with a baseline.
METRICS = ["mask_ratio", "mean_intensity", "std_intensity", "edge_density", "cavity_ratio", "bright_spots", "hu_dist", "dynamic_range", "local_entropy", "circularity", "bright_ratio", "dark_ratio", "banding_score", "edge_voids_px", "round_isolated", "round_density", "contour_concavity", "contour_perim_ratio"]
#: Metrics of the distance to the baseline.
Z_METRICS = METRICS[:10]
POINTS = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
PLACES = 9

# Tags that fail an item, group weights, penalties of soft reasons.
HARD_TAGS = ["BANDING", "BLOWOUT", "AREA_BAD", "DEAD_DARK", "GRID_SEAM", "SHAPE_ODD", "EDGE_VOIDS", "NO_PECTORAL", "MODALITY_LOW", "ARTIFACT_BUBBLES", "ANATOMY_NON_MAMMO", "CONTOUR_FRACTURED", "SKIN_LINE_MISSING", "CENTER_OVEREXPOSED", "CLIP_CROSS_ANATOMY", "ARTIFACT_TRYPOPHOBIA", "CLOSED_RING_ARTIFACT", "MASK_AREA_OUT_OF_DIST"]
GROUP_WEIGHTS = {"A": 0.2, "B": 0.1, "C": 0.2, "D": 0.25, "E": 0.05, "F": 0.2}
PENALTIES = {"MASK_AREA_OUT_OF_DIST": 0.08, "SKIN_LINE_MISSING": 0.07, "CLOSED_RING_ARTIFACT": 0.12, "GRID_SEAM": 0.05}

# Thresholds without a baseline.
DEFAULTS = {
    "min_mask": 0.001, "max_mask": 0.75, "min_circ": 0.32, "max_circ": 0.9, "max_mean": 0.7, "min_std": 0.05, "min_dr": 0.3, "max_dr": 0.95,
    "max_bright": 0.99, "max_dark": 0.25, "min_entropy": 0.0, "max_entropy": 4.5, "max_ps_emd": 0.22, "max_grad_wass": 0.2, "max_hist_wass": 0.15,
    "max_isolated": 6.0, "max_voids": 200.0, "edge_floor": 0.008, "min_banding": 0.62, "max_round_density": 0.04, "max_concavity": 0.45, "max_perim": 1.35,
    "max_cavity": 0.28, "max_spots": 20.0, "max_mirror": 0.84, "max_hu": 1.8, "max_z": 2.6, "chaos_hard": 0.4, "clip_margin": 0.04, "veto_group": 0.3, "require_pectoral": 0.0,
    "mean_p1": 0.1, "mean_p5": 0.2, "mean_p95": 0.7, "mean_p99": 0.85, "std_p1": 0.03, "std_p5": 0.05, "std_p95": 0.21, "std_p99": 0.28,
    "dr_p1": 0.25, "dr_p5": 0.35, "dr_p95": 0.95, "dr_p99": 1.0, "ent_p1": 0.5, "ent_p5": 1.0, "ent_p95": 4.5, "ent_p99": 5.5,
}


#: Rows from which percentiles are found by brackets: up to here a task can hold a metric's distinct values.
LARGE_ROWS = 4_000_000


def scalar_stats(items: DataFrame, metrics: list = METRICS, large: bool | None = None) -> DataFrame:
    """metric, n, p1 ... p99 (exact, linear between neighbours), mean, std (of the population). Percentiles come
    from one built-in aggregate, whose task holds all distinct values of a metric, or, for LARGE_ROWS rows and more, from
    counts of the values where a metric has few, in one pass over the items as they are, and for the other metrics from brackets,
    which no task holds whole, in two passes over those columns; all are exact. large: which of them, by default by the count."""
    if large is None:
        large = items.count() >= LARGE_ROWS
    if not large:
        mean, std = lambda v: F.round(F.avg(v), PLACES), lambda v: F.round(F.stddev_pop(v), PLACES)
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
        rows = items.select(F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
        found = rows.groupBy("metric").agg(F.count("value").alias("n"), F.percentile("value", F.array(*map(F.lit, POINTS.values()))).alias("points"), mean("value").alias("mean"), std("value").alias("std"))
        points = [F.round(F.get("points", F.lit(i)), PLACES).alias(k) for i, k in enumerate(POINTS)]
        return found.select("metric", "n", *points, "mean", "std")
    doubles = items.select(*[F.col(m).cast("double").alias(m) for m in metrics])
    counted, total = few_values(doubles)
    many = [m for m, c in zip(metrics, counted) if c is None]
    rows = [(m, int(c[1].sum()), *counted_percentiles(*c, POINTS).values(), *counted_moments(*c)) for m, c in zip(metrics, counted) if c is not None and total]
    if many:
        moments = [c.alias(f"{k}_{m}") for m in many for k, c in (("n", F.count(F.col(m))), ("mean", F.avg(F.col(m))), ("std", F.stddev_pop(F.col(m))))]
        points, row = wide_percentiles(doubles.select(*many), POINTS, 8192, 1e-3, *moments)
        rows += [(m, row[f"n_{m}"], *(p[k] for k in POINTS), row[f"mean_{m}"], row[f"std_{m}"]) for m, p in zip(many, points)]
    found = items.sparkSession.createDataFrame(rows, f"metric string, n long, {', '.join(f'{k} double' for k in POINTS)}, mean double, std double")
    return found.select("metric", "n", *[F.round(p, PLACES).alias(p) for p in (*POINTS, "mean", "std")])


def counted_moments(values: np.ndarray, n: np.ndarray) -> tuple[float | None, float | None]:
    """Mean and standard deviation (of the population) of values that occur n times."""
    if not len(values):
        return None, None
    mean = float((values * n).sum() / n.sum())
    return mean, float(np.sqrt((n * (values - mean) ** 2).sum() / n.sum()))


def density_prior(items: DataFrame) -> DataFrame:
    """Share of each density type, null as 'unknown'."""
    kinds = items.select(F.coalesce(density_type(F.col("mean_intensity"), F.col("std_intensity")), F.lit("unknown")).alias("density_type"))
    counts = kinds.groupBy("density_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("density_type", "n", F.round(F.col("n") / F.col("total"), PLACES).alias("prior"))


def baseline_row(stats: DataFrame, prior: DataFrame) -> DataFrame:
    """One row: stats as a map of structs, prior as a map. A row per metric and one per density type go in."""
    point = F.struct(*[F.col(c) for c in (*POINTS, "mean", "std")])
    s = stats.agg(F.map_from_entries(F.collect_list(F.struct("metric", point))).alias("stats"))
    p = prior.agg(F.map_from_entries(F.collect_list(F.struct("density_type", "prior"))).alias("prior"))
    return s.crossJoin(p)


# The metric and percentile from which a limit is calibrated. These need all four of p1, p5, p95 and p99.
CALIBRATED = {
    "min_mask": ("mask_ratio", "p1"), "soft_mask_lo": ("mask_ratio", "p5"), "soft_mask_hi": ("mask_ratio", "p95"), "max_mask": ("mask_ratio", "p99"),
    "min_circ": ("circularity", "p1"), "soft_circ_lo": ("circularity", "p5"), "soft_circ_hi": ("circularity", "p95"), "max_circ": ("circularity", "p99"),
    "max_mean": ("mean_intensity", "p99"),
    **{f"{short}_{p}": (m, p) for short, m in (("mean", "mean_intensity"), ("std", "std_intensity"), ("dr", "dynamic_range"), ("ent", "local_entropy")) for p in ("p1", "p5", "p95", "p99")},
}
# These need a p99 over a floor.
CALIBRATED_OVER = {"max_concavity": ("contour_concavity", 0), "max_perim": ("contour_perim_ratio", 1), "max_round_density": ("round_density", 0)}
CLAMPS = {"min_circ": lambda v: F.greatest(F.lit(0.1), v), "max_mean": lambda v: F.least(F.lit(0.99), v)}
#: The default of a limit that has none of its own.
STANDS_FOR = {"soft_mask_lo": "min_mask", "soft_mask_hi": "max_mask", "soft_circ_lo": "min_circ", "soft_circ_hi": "max_circ"}
STATS = "map<string,struct<p1:double,p5:double,p50:double,p95:double,p99:double,mean:double,std:double>>"


def limits_and_sources() -> dict[str, tuple[Column, Column]]:
    """Limit -> (value, where it comes from), over the map `stats` of a baseline, which may be null."""
    at = lambda m, p: F.try_element_at("stats", F.lit(m))[p]
    out = {k: (F.lit(v), F.lit("default")) for k, v in DEFAULTS.items()}
    for name, (m, p) in CALIBRATED.items():
        full = at(m, "p1").isNotNull() & at(m, "p5").isNotNull() & at(m, "p95").isNotNull() & at(m, "p99").isNotNull()
        value = CLAMPS.get(name, lambda v: v)(at(m, p))
        out[name] = F.when(full, value).otherwise(F.lit(DEFAULTS[STANDS_FOR.get(name, name)])), F.when(full, f"{m} {p}").otherwise("default")
    for name, (m, over) in CALIBRATED_OVER.items():
        out[name] = F.when(at(m, "p99") > over, at(m, "p99")).otherwise(F.lit(DEFAULTS[name])), F.when(at(m, "p99") > over, f"{m} p99").otherwise("default")
    return out


def calibrated(baseline: DataFrame | None, spark=None, **given: float) -> DataFrame:
    """One row of thresholds, and the baseline's maps. Without a baseline (None) the defaults and nulls. given: limits
    that neither defaults nor baseline decide; require_pectoral is 1 where an item without one fails."""
    if baseline is None:
        row = spark.range(1).select(F.lit(None).cast(STATS).alias("stats"), F.lit(None).cast("map<string,double>").alias("prior"))
    else:
        row = baseline
    new = {k: v for k, (v, _) in limits_and_sources().items()} | {k: F.lit(v) for k, v in given.items()}
    return row.select(F.struct(*[v.cast("double").alias(k) for k, v in new.items()]).alias("t"), "stats", "prior")


def limit_rows(stats: DataFrame | None, spark=None) -> DataFrame:
    """limit, value, source ('default', or the metric and percentile): what `calibrated` decides, a row per limit. stats:
    rows of `scalar_stats`; None: the defaults."""
    if stats is None:
        row = spark.range(1).select(F.lit(None).cast(STATS).alias("stats"))
    else:
        row = stats.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*[F.col(c) for c in (*POINTS, "mean", "std")])))).alias("stats"))
    every = F.array(*[F.struct(F.lit(k).alias("limit"), v.cast("double").alias("value"), w.alias("source")) for k, (v, w) in limits_and_sources().items()])
    return row.select(F.inline(every))


def _when(*cases, default) -> Column:
    """Ordered cases of (condition, value)."""
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(default)


def grade_columns(tag: Callable[[str | None], Column] = lambda name: F.lit(name).cast("string")) -> dict[str, tuple[Column, Column]]:
    """Grade -> (score, tag or null), over an item's columns and the threshold struct t. tag: what stands for a tag's name, or for
    the None of a case without one."""
    c = F.col
    t = lambda k: F.col("t")[k]
    mask, circ, conc, per = c("mask_ratio"), c("circularity"), c("contour_concavity"), c("contour_perim_ratio")
    in_soft = (mask >= t("soft_mask_lo")) & (mask <= t("soft_mask_hi"))
    in_hard = (mask >= t("min_mask")) & (mask <= t("max_mask"))
    circ_soft = (circ >= t("soft_circ_lo")) & (circ <= t("soft_circ_hi"))
    center = (t("soft_circ_lo") + t("soft_circ_hi")) / 2
    mean, std, dr, ent = c("mean_intensity"), c("std_intensity"), c("dynamic_range"), c("local_entropy")
    band = lambda x, k: double_band(x, t(f"{k}_p1"), t(f"{k}_p5"), t(f"{k}_p95"), t(f"{k}_p99"))
    bright_budget, dark_budget = F.greatest(F.lit(1e-4), t("max_bright")), F.greatest(F.lit(1e-4), t("max_dark"))
    bright, dark = c("bright_ratio"), c("dark_ratio")
    spare = lambda r, b: clip01(1 - F.greatest(F.lit(0.0), r - 0.5 * b) / b)
    distance = lambda d, most: F.when(d.isNull(), 1.0).otherwise(clip01(1 - d / (most + 1e-6)))
    slope, brisque, chaos, margin = c("ps_slope"), c("brisque"), c("anatomy_chaos"), F.coalesce(c("clip_margin_seen"), F.lit(100.0))
    prior_of = lambda kind: F.coalesce(F.try_element_at("prior", F.lit(kind)), F.lit(0.0))
    prior = F.coalesce(density_type(mean, std, prior_of), prior_of("unknown"))
    no_prior = F.coalesce(F.size("prior"), F.lit(0)) <= 0
    voids = F.greatest(F.lit(50.0), 2 * F.greatest(F.lit(1.0), t("max_voids")))
    return {
        "A1": (_when((in_soft, 1.0), (in_hard, 0.6), default=0.0), _when((in_soft, tag(None)), (in_hard, tag("AREA_BORDER")), default=tag("AREA_BAD"))),
        "A2": (F.when(circ_soft, 1.0).otherwise(clip01(1 - F.abs(circ - center) * 3)), F.when(~circ_soft, tag("SHAPE_ODD"))),
        "A3": (_when((c("pectoral_found"), 1.0), (t("require_pectoral") > 0, 0.0), default=0.7), F.when(~c("pectoral_found") & (t("require_pectoral") > 0), tag("NO_PECTORAL"))),
        "A4": ((clip01(1 - conc / F.greatest(F.lit(0.001), t("max_concavity"))) + clip01(1 - F.greatest(F.lit(0.0), per - 1) / F.greatest(F.lit(0.001), F.greatest(F.lit(1.01), t("max_perim")) - 1))) / 2, F.when((conc > t("max_concavity")) | (per > t("max_perim")), tag("CONTOUR_FRACTURED"))),
        "A5": (c("vert_struct_score"), F.when(c("vert_struct_score") < 0.25, tag("VERTICAL_SPINE"))),
        "A6": (F.when(chaos >= t("chaos_hard"), 0.0).otherwise(clip01(1 - chaos / F.greatest(t("chaos_hard"), F.lit(1e-6)))), F.when(chaos >= t("chaos_hard"), tag("ANATOMY_NON_MAMMO"))),
        "A7": (_when((margin > 50, 1.0), (margin < t("clip_margin"), 0.0), default=clip01((margin - t("clip_margin")) / F.greatest(F.lit(1e-6), 0.14 - t("clip_margin")))), F.when((margin <= 50) & (margin < t("clip_margin")), tag("CLIP_CROSS_ANATOMY"))),
        "B1": ((band(mean, "mean") + band(std, "std")) / 2, F.when(std < t("min_std"), tag("LOW_CONTRAST")).when(mean > t("max_mean"), tag("OVEREXPOSED"))),
        "B2": (band(dr, "dr"), F.when(dr < t("min_dr"), tag("LOW_DR")).when(dr > t("max_dr"), tag("OVER_STRETCHED"))),
        "B3": (spare(bright, bright_budget) * spare(dark, dark_budget), F.when(bright > t("max_bright"), tag("BLOWOUT")).when(dark > t("max_dark"), tag("DEAD_DARK"))),
        "C1": (distance(c("ps_emd"), t("max_ps_emd")), F.when(c("ps_emd") > t("max_ps_emd"), tag("PSD_OFF"))),
        "C2": (band(ent, "ent"), F.when(ent < t("min_entropy"), tag("TOO_UNIFORM")).when(ent > t("max_entropy"), tag("TOO_NOISY"))),
        "C3": (distance(c("grad_wass"), t("max_grad_wass")), F.when(c("grad_wass") > t("max_grad_wass"), tag("GRAD_OFF"))),
        "D1": (F.when(c("round_isolated") <= t("max_isolated"), 1.0).otherwise(clip01(1 - (c("round_isolated") - t("max_isolated")) * 0.2)), F.when(c("round_isolated") > t("max_isolated"), tag("ARTIFACT_BUBBLES"))),
        "D2": (clip01(1 - c("edge_voids_px") / voids), F.when(c("edge_voids_px") > t("max_voids"), tag("EDGE_VOIDS"))),
        "D3": (c("banding_score"), F.when(c("banding_score") < t("min_banding"), tag("BANDING"))),
        "D4": (clip01(1 - c("round_density") / F.greatest(F.lit(1e-4), t("max_round_density"))), F.when(c("round_density") > t("max_round_density"), tag("ARTIFACT_TRYPOPHOBIA"))),
        "D5": (c("grid_pattern_score"), F.when(c("grid_pattern_score") < 0.3, tag("GRID_ARTIFACT"))),
        "E1": (distance(c("hist_wass"), t("max_hist_wass")), F.when(c("hist_wass") > t("max_hist_wass"), tag("HIST_OFF"))),
        "E2": (_when((no_prior | (prior >= 0.2), 1.0), (prior >= 0.05, 0.6), default=0.3), F.when(~no_prior & (prior < 0.05), tag("DENSITY_MISMATCH"))),
        "F1": (
            _when((slope <= 0, 0.5), ((slope >= 2) & (slope <= 3.8), 1.0), ((slope >= 1.2) & (slope < 2), clip01(0.4 + 0.6 * (slope - 1.2) / 0.8)), ((slope > 3.8) & (slope <= 5), clip01(0.4 + 0.6 * (5 - slope) / 1.2)), default=0.0),
            _when(((slope <= 0) | ((slope >= 2) & (slope <= 3.8)), tag(None)), (slope < 2, tag("PS_SLOPE_LOW")), default=tag("PS_SLOPE_HIGH")),
        ),
        "F2": (_when((brisque < 0, 0.5), (brisque <= 20, 1.0), (brisque <= 60, clip01(1 - (brisque - 20) / 40 * 0.5)), (brisque <= 70, clip01(0.5 - (brisque - 60) / 10 * 0.5)), default=0.0), F.when(brisque > 60, tag("HIGH_BRISQUE"))),
    }


def literal(value, kind) -> Column:
    """A double, a struct of doubles, or a map from strings to either, as a foldable column."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, dict):
        if not value:
            return F.create_map().cast(kind)
        return F.create_map(*[c for k, v in value.items() for c in (F.lit(k), literal(v, kind.valueType))])
    if isinstance(value, Row):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


GRADES = ["A1", "A2", "A3", "A4", "A5", "A6", "A7", "B1", "B2", "B3", "C1", "C2", "C3", "D1", "D2", "D3", "D4", "D5", "E1", "E2", "F1", "F2"]


def present(*names: Column) -> Column:
    """The array of the names that are not null. What array_compact gives, but for names that are never empty texts: its lambda
    has no generated code, so that all conditions under it would be interpreted for every row."""
    return F.array_remove(F.array(*[F.coalesce(n, F.lit("")) for n in names]), "")


def any_true(*conditions: Column) -> Column:
    """Whether one of them holds; null does not."""
    return functools.reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in conditions])


def graded(items: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds a score per grade, tags, and hard_tag: whether one of HARD_TAGS is among them, from the rules themselves, so that for that no
    item's tags are named, put into an array or searched. ps_emd, grad_wass, hist_wass and clip_margin_seen may be absent.
    The one row of thresholds is read here and becomes literals, which Catalyst folds into the grades, so rows carry no
    limits and no maps. The session's limit for generated methods is lowered to what the JVM compiles (8,000 bytes,
    which Spark's documentation recommends): the grades in one method over it would be interpreted, seven times slower; under it
    Spark splits them. It changes no result and stays set, since rows are made when the result is read."""
    items.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    for name in ("ps_emd", "grad_wass", "hist_wass", "clip_margin_seen"):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast("double"))
    given = thresholds.first()
    joined = items.withColumns({name: literal(given[name], thresholds.schema[name].dataType) for name in thresholds.columns})
    grades = grade_columns()
    tags = [grades[g][1] for g in GRADES]
    fails = grade_columns(lambda name: F.lit(True if name in HARD_TAGS else None).cast("boolean"))
    hard = any_true(*[fails[g][1] for g in GRADES])
    return joined.select("*", *[rounded(grades[g][0], PLACES).alias(g) for g in GRADES], present(*tags).alias("tags"), hard.alias("hard_tag"))


def totalled(rows: DataFrame, weights: dict = GROUP_WEIGHTS) -> DataFrame:
    """Group means, total, failed groups, has_veto (whether there are any, without an array), reasons of the plain limits, and ok."""
    c = F.col
    t = lambda k: F.col("t")[k]
    members = {g: [x for x in GRADES if x[0] == g] for g in "ABCDEF"}
    means = {f"group_{g}": sum((c(x) for x in xs[1:]), c(xs[0])) / len(xs) for g, xs in members.items()}
    means["group_C"] = F.least(means["group_C"], F.when(c("edge_density") < t("edge_floor"), 0.5))  # a null is no limit
    rows = rows.withColumns({k: rounded(v, PLACES) for k, v in means.items()})
    total = rounded(100 * sum((c(f"group_{g}") * w for g, w in list(weights.items())[1:]), c("group_A") * weights["A"]), PLACES)
    z = ref_z()
    legacy = present(
        F.when((c("mask_ratio") < t("min_mask")) | (c("mask_ratio") > t("max_mask")), "mask_ratio"),
        F.when(c("cavity_ratio") > t("max_cavity"), "large_cavity"),
        F.when(c("bright_spots") > t("max_spots"), "bright_spots"),
        F.when(c("mirror_sim") > t("max_mirror"), "bilateral_symmetry"),
        F.when(c("hu_dist") > t("max_hu"), "shape_hu"),
        F.when(z > t("max_z"), "off_real_distribution"),
        F.when(c("stats").isNotNull() & (c("ps_emd") > t("max_ps_emd")), "psd_off_real"),
    )
    fails = {g: c(f"group_{g}") < t("veto_group") for g in "ABCDE"}
    failed = present(*[F.when(f, g) for g, f in fails.items()])
    rows = rows.withColumns({"total_score": total, "ref_z": z, "legacy_reasons": legacy, "group_veto": failed, "has_veto": any_true(*fails.values())})
    hard = c("hard_tag") if "hard_tag" in rows.columns else F.arrays_overlap("tags", F.array(*map(F.lit, HARD_TAGS)))
    return rows.withColumn("ok", (c("total_score") >= 50) & ~hard & ~c("has_veto"))


def ref_z() -> Column:
    """Mean distance to the baseline's means, in standard deviations; null without a baseline."""
    one = lambda m: F.abs(F.col(m) - F.col("stats")[m]["mean"]) / (F.col("stats")[m]["std"] + 1e-6)
    return F.when(F.col("stats").isNotNull(), rounded(sum((one(m) for m in Z_METRICS[1:]), one(Z_METRICS[0])) / len(Z_METRICS), 6))


def funnel(rows: DataFrame, modality_veto: float = 0.85) -> DataFrame:
    """funnel_veto and soft_reasons from modality_p and the flags center_overexposed, skin_line_present,
    closed_ring, mask_area_out, seam; from the same flags, without arrays, in_funnel (whether there is a veto) and soft_loss."""
    c = F.col
    vetoes = {"MODALITY_LOW": c("modality_p") < modality_veto, "CENTER_OVEREXPOSED": c("center_overexposed")}
    reasons = {"MASK_AREA_OUT_OF_DIST": c("mask_area_out"), "SKIN_LINE_MISSING": ~c("skin_line_present"), "CLOSED_RING_ARTIFACT": c("closed_ring"), "GRID_SEAM": c("seam")}
    veto, soft = (present(*[F.when(holds, k) for k, holds in named.items()]) for named in (vetoes, reasons))
    return rows.withColumns({"funnel_veto": veto, "soft_reasons": soft, "in_funnel": any_true(*vetoes.values()), "soft_loss": penalty(reasons.get)})


def penalty(holds: Callable[[str], Column]) -> Column:
    """The penalties of the soft reasons that hold."""
    return sum((F.when(holds(k), v).otherwise(0.0) for k, v in PENALTIES.items()), F.lit(0.0))


def tiered(rows: DataFrame, tier1: float = 0.8, tier2: float = 0.5) -> DataFrame:
    """semantic_score, tier, final_rank_score, and ok without a funnel veto. Needs total_score, modality_p,
    radiomics_score (null: not measured), mask_iou (null: no pair), and from `funnel` soft_loss and in_funnel or else soft_reasons and funnel_veto."""
    c = F.col
    quality = clip01(c("total_score") / 100)
    p, r = F.coalesce("modality_p", F.lit(0.72)), F.coalesce(F.nullif(F.col("radiomics_score"), F.lit(0.0)), F.lit(0.5))
    raw = (
        F.when(c("modality_p").isNull() & c("radiomics_score").isNull(), 0.55 + 0.45 * quality)
        .when(c("mask_iou").isNull(), 0.58 * p + 0.42 * r)
        .otherwise(0.5 * p + 0.35 * r + 0.15 * clip01(c("mask_iou")))
    )
    soft = c("soft_reasons")
    loss = c("soft_loss") if "soft_loss" in rows.columns else F.when(soft.isNotNull(), penalty(lambda k: F.array_contains(soft, k)))
    vetoed = c("in_funnel") if "in_funnel" in rows.columns else F.size("funnel_veto") > 0
    rows = rows.withColumn("semantic_score", rounded(clip01(raw - loss), 13))
    s = c("semantic_score")
    rows = rows.withColumn("tier", F.when(s > tier1, 1).when(s > tier2, 2).otherwise(3))
    rank = F.when(c("tier") == 1, 0.6 * s + 0.4 * quality).otherwise(s * 0.3)
    return rows.withColumns({"final_rank_score": rounded(rank, 14), "ok": c("ok") & ~vetoed})
