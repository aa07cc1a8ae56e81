"""Cleaning a catalogue: lookup of classes, quality rules, reject reasons, strata, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the four density classes, the form of a series' name, and the part of a path before the
# image's own.
DENSITY_NAMES = {"1": "fatty", "2": "scattered", "3": "heterogeneous", "4": "dense"}
SERIES_ID = r"(?i)(P_\d+)_(LEFT|RIGHT)_(CC|MLO)"
JPEG_MARK = "CBIS-DDSM/jpeg/"
# What a row can be rejected for.
MISSING = ("missing_density", "missing_file")
REJECTS = ("read_failed", "too_small_or_cropped", "mask_ratio_out_of_range", "empty_breast_mask", "overexposed", "underexposed", "skin_line_missing", "marker_or_ruler_heavy")
#: Counter -> the reason that it counts.
REASON_COUNTERS = {r: r for r in MISSING} | {f"reject_{r}": r for r in REJECTS}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def density_name(code: Column) -> Column:
    """Name of a density code; null for any other code."""
    return F.try_element_at(literal_map(DENSITY_NAMES), F.trim(code))


def clean_cases(cases: DataFrame) -> DataFrame:
    """patient_id, laterality, view, density of the usable case rows, with their order."""
    return cases.select(
        F.trim("patient_id").alias("patient_id"),
        F.upper(F.trim("side")).alias("laterality"),
        F.upper(F.trim("view_raw")).alias("view"),
        density_name(F.col("density_code")).alias("density"),
        "file_ord",
        "row_ord",
    ).filter((F.col("patient_id") != "") & (F.col("laterality") != "") & F.col("view").isin("CC", "MLO") & F.col("density").isNotNull())


def density_lookup(cases: DataFrame) -> DataFrame:
    """One density per (patient_id, laterality, view): that of the last row of the last file."""
    return clean_cases(cases).groupBy("patient_id", "laterality", "view").agg(F.max_by("density", F.struct("file_ord", "row_ord")).alias("density"))


def full_series(catalog: DataFrame) -> DataFrame:
    """Rows of whole images, with patient, side and view taken from the series id."""
    part = lambda i: F.regexp_extract("series_id", SERIES_ID, i)
    return catalog.filter((F.trim("modality") == "MG") & F.lower(F.trim("series_description")).contains("full mammogram") & F.col("series_id").rlike(SERIES_ID)).withColumns(
        {"patient_id": part(1), "laterality": F.upper(part(2)), "view": F.upper(part(3))}
    )


def relative_path(path: Column) -> Column:
    """What follows the first mark, else the file's name."""
    at = F.instr(path, JPEG_MARK)
    return F.when(at > 0, F.substring(path, at + len(JPEG_MARK), F.length(path))).otherwise(F.substring_index(path, "/", -1))


def mask_path(path: Column) -> Column:
    """What follows the last /jpeg/, or else the last two parts, with .png for .jpg."""
    rel = F.when(F.instr(path, "/jpeg/") > 0, F.substring_index(path, "/jpeg/", -1)).otherwise(F.substring_index(path, "/", -2))
    return F.regexp_replace(rel, r"\.(?:jpg|JPG)", ".png")


def with_density(series: DataFrame, cases: DataFrame) -> DataFrame:
    """Left join with the lookup. It has a row per (patient, side, view), so its size is not bounded:
    Catalyst broadcasts it if its statistics say that it is small, and else joins by key."""
    return series.join(density_lookup(cases), ["patient_id", "laterality", "view"], "left")


def quality_reasons(min_long=1200, min_short=700, min_mask=0.03, max_mask=0.90, max_extreme=0.05, min_pixels=1000, max_markers=40) -> Column:
    """The rules that a row breaks, in order. Needs height, width, mask_ratio, mask_pixels, bright_ratio,
    dark_ratio, skin_line, marker_score; a null height is a failed read and the only reason then."""
    long, short = F.greatest("height", "width"), F.least("height", "width")
    empty = F.col("mask_pixels") < min_pixels
    rules = [
        ("too_small_or_cropped", (long < min_long) | (short < min_short)),
        ("mask_ratio_out_of_range", (F.col("mask_ratio") < min_mask) | (F.col("mask_ratio") > max_mask)),
        ("empty_breast_mask", empty),
        ("overexposed", ~empty & (F.col("bright_ratio") > max_extreme)),
        ("underexposed", ~empty & (F.col("dark_ratio") > max_extreme)),
        ("skin_line_missing", ~F.col("skin_line")),
        ("marker_or_ruler_heavy", F.col("marker_score") > max_markers),
    ]
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return F.when(F.col("height").isNull(), F.array(F.lit("read_failed"))).otherwise(hits)


def quality_checked(rows: DataFrame, **limits) -> DataFrame:
    """Adds reasons and ok; an empty mask counts as wholly bright and dark."""
    empty = F.col("mask_pixels") < limits.get("min_pixels", 1000)
    checked = rows.withColumn("reasons", quality_reasons(**limits))
    return checked.withColumns({"ok": F.size("reasons") == 0, "bright_ratio": F.when(empty, 1.0).otherwise(F.col("bright_ratio")), "dark_ratio": F.when(empty, 1.0).otherwise(F.col("dark_ratio"))})


def with_status(rows: DataFrame) -> DataFrame:
    """reasons as they take precedence: no density, then no file, then the quality rules. Needs density,
    has_file and reasons."""
    return rows.withColumn("reasons", F.when(F.col("density").isNull(), F.array(F.lit("missing_density"))).when(~F.col("has_file"), F.array(F.lit("missing_file"))).otherwise(F.col("reasons")))


def strata_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("view", "density").agg(F.count("*").alias("n"))


def strata_summary(strata: DataFrame, warn_spread: float = 0.20, warn_kept: int = 2000) -> DataFrame:
    """Smallest and largest stratum, their ratio, and the two warnings."""
    lo, hi, kept = F.min("n"), F.max("n"), F.sum("n")
    return strata.agg(
        kept.alias("kept"),
        lo.alias("min_stratum"),
        hi.alias("max_stratum"),
        F.round(hi / F.greatest(F.lit(1.0), lo.cast("double")), 4).alias("imbalance_ratio"),
        ((hi - lo) / hi > warn_spread).alias("warn_unbalanced"),
        (kept < warn_kept).alias("warn_few"),
    )


def reason_counters(rows: DataFrame) -> DataFrame:
    """kept, missing_* and reject_* counts of rows with reasons."""
    what = F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("kept"))).otherwise(F.transform("reasons", lambda r: F.when(r.startswith("missing_"), r).otherwise(F.concat(F.lit("reject_"), r)))))
    return rows.select(what.alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
