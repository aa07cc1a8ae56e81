"""Queries of baselines, thresholds, grades, totals, tiers and batch summaries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..operators import grading as op
from ..operators import growing, runs
from ..sources.adapters import load
from ..sources.scratch import scratch_path, stored
from .registry import query

EXTRAS = {
    "ps_emd": "bright_spots / 100.0D", "grad_wass": "edge_voids_px / 1000.0D", "hist_wass": "round_isolated / 40.0D", "clip_margin_seen": "case when bright_spots % 4 = 0 then circularity / 5 end",
    "center_overexposed": "bright_ratio > 0.09D", "skin_line_present": "dark_ratio < 0.3D", "closed_ring": "bright_spots = 7", "mask_area_out": "mask_ratio > 0.95D", "seam": "bright_spots = 3",
    "radiomics_score": "case when round_isolated > 0 then round_isolated / 10.0D end", "mask_iou": "case when edge_voids_px % 2 = 1 then mirror_sim end",
}


def plain(text: str) -> str:
    """The oracle's form of an expression that both engines take but for the suffix of doubles."""
    import re

    return re.sub(r"(\d+\.\d+)D\b", r"\1::double", text)


def items(spark, sf_dir):
    """item_metrics with the distances, flags and scores that other jobs deliver."""
    return load(spark, sf_dir, "item_metrics").selectExpr("*", *[f"{e} as {n}" for n, e in EXTRAS.items()])


def reviewed(spark, sf_dir, calibrate: bool = True, **given):
    """Every item graded, totalled and tiered. Thresholds are settled first, so that grading reads columns of
    one row and not the expressions that made them. given: limits of its own."""
    rows = items(spark, sf_dir)
    base = None
    if calibrate:
        real = rows.filter("is_real")
        base = stored(op.baseline_row(op.scalar_stats(real), op.density_prior(real)), "baseline")
    thresholds = stored(op.calibrated(base, spark, **given), "thresholds")
    return op.tiered(op.funnel(op.totalled(op.graded(rows, thresholds))))


VERDICT = ("run_name", "item", "ok", "tier", "total_score", "semantic_score", "final_rank_score", "ps_slope", "brisque", "group_veto", "tags", *(f"group_{g}" for g in "ABCDEF"))


def review_table(spark, sf_dir, *columns: str):
    """The reviewed items as a written table of the columns that a query needs, for queries that filter on
    verdicts: pushed down, such a filter would take the whole chain of grades with it."""
    return stored(reviewed(spark, sf_dir).select(*(columns or VERDICT)), "review")


ITEMS = "items as (select *, " + ", ".join(f"{plain(e)} as {n}" for n, e in EXTRAS.items()) + " from item_metrics)"
REAL = "select " + ", ".join(f"cast({m} as double) as {m}" for m in op.METRICS) + " from item_metrics where is_real"
STATS = f"""stats as (select metric, count(value) as n, {', '.join(f'round(quantile_cont(value, {q}), 9) as {p}' for p, q in op.POINTS.items())}, round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std
 from (unpivot ({REAL}) on columns(*) into name metric value value) group by metric)"""
KIND = "coalesce(case when mean_intensity < 0.33 and std_intensity < 0.1 then 'a_fatty' when mean_intensity < 0.45 and std_intensity < 0.12 then 'b_scattered' when std_intensity >= 0.16 and mean_intensity >= 0.55 then 'd_extreme' when std_intensity >= 0.14 or mean_intensity >= 0.55 then 'c_hetero' end, 'unknown')"
PRIOR = f"prior as (select density_type, n, round(n / sum(n) over (), 9) as prior from (select {KIND} as density_type, count(*) as n from item_metrics where is_real group by 1))"


def _threshold_sql(by: str = "") -> str:
    s = lambda m, p: f"max(case when metric = '{m}' then {p} end)"
    new = {k: f"{v}::double" for k, v in op.DEFAULTS.items()}
    new |= {"min_mask": s("mask_ratio", "p1"), "max_mask": s("mask_ratio", "p99"), "soft_mask_lo": s("mask_ratio", "p5"), "soft_mask_hi": s("mask_ratio", "p95")}
    new |= {"min_circ": f"greatest(0.1::double, {s('circularity', 'p1')})", "max_circ": s("circularity", "p99"), "soft_circ_lo": s("circularity", "p5"), "soft_circ_hi": s("circularity", "p95")}
    for short, m in (("mean", "mean_intensity"), ("std", "std_intensity"), ("dr", "dynamic_range"), ("ent", "local_entropy")):
        new |= {f"{short}_{p}": s(m, p) for p in ("p1", "p5", "p95", "p99")}
    new["max_mean"] = f"least(0.99::double, {s('mean_intensity', 'p99')})"
    for name, m, over in (("max_concavity", "contour_concavity", 0), ("max_perim", "contour_perim_ratio", 1), ("max_round_density", "round_density", 0)):
        new[name] = f"case when {s(m, 'p99')} > {over} then {s(m, 'p99')} else {op.DEFAULTS[name]}::double end"
    return f"t as (select {by}{', ' if by else ''}" + ", ".join(f"{v} as {k}" for k, v in new.items()) + f" from stats{f' group by {by}' if by else ''})"


def _clip(x: str) -> str:
    return f"greatest(0::double, least(1::double, {x}))"


def _band(x: str, k: str) -> str:
    p1, p5, p95, p99 = (f"{k}_{p}" for p in ("p1", "p5", "p95", "p99"))
    low, high = f"greatest(1e-6::double, {p5} - {p1})", f"greatest(1e-6::double, {p99} - {p95})"
    return (
        f"case when {x} between {p5} and {p95} then 1::double when {x} < {p5} and {x} >= {p1} then 0.3::double + 0.7::double * ({x} - {p1}) / {low}"
        f" when {x} < {p5} then greatest(0::double, 0.3::double - 0.3::double * ({p1} - {x}) / {low}) when {x} <= {p99} then 0.3::double + 0.7::double * ({p99} - {x}) / {high}"
        f" else greatest(0::double, 0.3::double - 0.3::double * ({x} - {p99}) / {high}) end"
    )


def _grade_sql() -> dict[str, tuple[str, str]]:
    mid = "(soft_circ_lo + soft_circ_hi) / 2"
    margin = "coalesce(clip_margin_seen, 100)"
    prior = "coalesce((select max(prior.prior) from prior where prior.density_type = kind), 0)"
    spare = lambda r, b: _clip(f"1 - greatest(0::double, {r} - 0.5::double * {b}) / {b}")
    off = lambda d, m, tag: (f"case when {d} is null then 1::double else {_clip(f'1 - {d} / ({m} + 1e-6::double)')} end", f"case when {d} > {m} then '{tag}' end")
    return {
        "A1": ("case when mask_ratio between soft_mask_lo and soft_mask_hi then 1 when mask_ratio between min_mask and max_mask then 0.6::double else 0 end", "case when mask_ratio between soft_mask_lo and soft_mask_hi then null when mask_ratio between min_mask and max_mask then 'AREA_BORDER' else 'AREA_BAD' end"),
        "A2": (f"case when circularity between soft_circ_lo and soft_circ_hi then 1 else {_clip(f'1 - abs(circularity - {mid}) * 3')} end", "case when not circularity between soft_circ_lo and soft_circ_hi then 'SHAPE_ODD' end"),
        "A3": ("case when pectoral_found then 1 when require_pectoral > 0 then 0 else 0.7::double end", "case when not pectoral_found and require_pectoral > 0 then 'NO_PECTORAL' end"),
        "A4": (f"({_clip('1 - contour_concavity / greatest(0.001::double, max_concavity)')} + {_clip('1 - greatest(0::double, contour_perim_ratio - 1) / greatest(0.001::double, greatest(1.01::double, max_perim) - 1)')}) / 2", "case when contour_concavity > max_concavity or contour_perim_ratio > max_perim then 'CONTOUR_FRACTURED' end"),
        "A5": ("vert_struct_score", "case when vert_struct_score < 0.25::double then 'VERTICAL_SPINE' end"),
        "A6": (f"case when anatomy_chaos >= chaos_hard then 0 else {_clip('1 - anatomy_chaos / chaos_hard')} end", "case when anatomy_chaos >= chaos_hard then 'ANATOMY_NON_MAMMO' end"),
        "A7": (f"case when {margin} > 50 then 1 when {margin} < clip_margin then 0 else {_clip(f'({margin} - clip_margin) / greatest(1e-6::double, 0.14::double - clip_margin)')} end", f"case when {margin} < clip_margin then 'CLIP_CROSS_ANATOMY' end"),
        "B1": (f"({_band('mean_intensity', 'mean')} + {_band('std_intensity', 'std')}) / 2", "case when std_intensity < min_std then 'LOW_CONTRAST' when mean_intensity > max_mean then 'OVEREXPOSED' end"),
        "B2": (_band("dynamic_range", "dr"), "case when dynamic_range < min_dr then 'LOW_DR' when dynamic_range > max_dr then 'OVER_STRETCHED' end"),
        "B3": (f"{spare('bright_ratio', 'max_bright')} * {spare('dark_ratio', 'max_dark')}", "case when bright_ratio > max_bright then 'BLOWOUT' when dark_ratio > max_dark then 'DEAD_DARK' end"),
        "C1": off("ps_emd", "max_ps_emd", "PSD_OFF"),
        "C2": (_band("local_entropy", "ent"), "case when local_entropy < min_entropy then 'TOO_UNIFORM' when local_entropy > max_entropy then 'TOO_NOISY' end"),
        "C3": off("grad_wass", "max_grad_wass", "GRAD_OFF"),
        "D1": (f"case when round_isolated <= max_isolated then 1 else {_clip('1 - (round_isolated - max_isolated) * 0.2::double')} end", "case when round_isolated > max_isolated then 'ARTIFACT_BUBBLES' end"),
        "D2": (_clip("1 - edge_voids_px / greatest(50, 2 * greatest(1, max_voids))"), "case when edge_voids_px > max_voids then 'EDGE_VOIDS' end"),
        "D3": ("banding_score", "case when banding_score < min_banding then 'BANDING' end"),
        "D4": (_clip("1 - round_density / greatest(1e-4::double, max_round_density)"), "case when round_density > max_round_density then 'ARTIFACT_TRYPOPHOBIA' end"),
        "D5": ("grid_pattern_score", "case when grid_pattern_score < 0.3::double then 'GRID_ARTIFACT' end"),
        "E1": off("hist_wass", "max_hist_wass", "HIST_OFF"),
        "E2": (f"case when {prior} >= 0.2::double then 1 when {prior} >= 0.05::double then 0.6::double else 0.3::double end", f"case when {prior} < 0.05::double then 'DENSITY_MISMATCH' end"),
        "F1": (
            f"case when ps_slope <= 0 then 0.5::double when ps_slope between 2 and 3.8::double then 1 when ps_slope >= 1.2::double and ps_slope < 2 then {_clip('0.4::double + 0.6::double * (ps_slope - 1.2::double) / 0.8::double')} when ps_slope > 3.8::double and ps_slope <= 5 then {_clip('0.4::double + 0.6::double * (5 - ps_slope) / 1.2::double')} else 0 end",
            "case when ps_slope <= 0 or ps_slope between 2 and 3.8::double then null when ps_slope < 2 then 'PS_SLOPE_LOW' else 'PS_SLOPE_HIGH' end",
        ),
        "F2": (f"case when brisque < 0 then 0.5::double when brisque <= 20 then 1 when brisque <= 60 then {_clip('1 - (brisque - 20) / 40 * 0.5::double')} when brisque <= 70 then {_clip('0.5::double - (brisque - 60) / 10 * 0.5::double')} else 0 end", "case when brisque > 60 then 'HIGH_BRISQUE' end"),
    }


def _chain() -> str:
    g = _grade_sql()
    mean = lambda x: "(" + " + ".join(k for k in op.GRADES if k[0] == x) + f") / {sum(k[0] == x for k in op.GRADES)}"
    hard = ", ".join(f"'{x}'" for x in op.HARD_TAGS)
    z = " + ".join(f"abs({m} - (select mean from stats where metric = '{m}')) / ((select std from stats where metric = '{m}') + 1e-6::double)" for m in op.Z_METRICS)
    total = " + ".join(f"group_{x} * {w}::double" for x, w in op.GROUP_WEIGHTS.items())
    q = _clip("total_score / 100")
    p, r = "coalesce(modality_p, 0.72::double)", "coalesce(nullif(radiomics_score, 0), 0.5::double)"
    loss = " + ".join(f"case when list_contains(soft_reasons, '{k}') then {v}::double else 0 end" for k, v in op.PENALTIES.items())
    return f"""{ITEMS}, {STATS}, {PRIOR}, {_threshold_sql()},
scored as (select items.*, t.*, {', '.join(f'round({s}, 9) as {k}' for k, (s, _) in g.items())}, [x for x in [{', '.join(tag for _, tag in g.values())}] if x is not null] as tags from (select *, {KIND} as kind from items) items cross join t),
grouped as (select *, {', '.join(f'round({mean(x)}, 9) as group_{x}' for x in 'ABDEF')}, round(case when edge_density < edge_floor then least({mean('C')}, 0.5::double) else {mean('C')} end, 9) as group_C, round(({z}) / {len(op.Z_METRICS)}, 6) as ref_z from scored),
totalled as (select *, round(100 * ({total}), 9) as total_score, [x for x in [{', '.join(f"case when group_{x} < veto_group then '{x}' end" for x in 'ABCDE')}] if x is not null] as group_veto,
  [x for x in [case when mask_ratio < min_mask or mask_ratio > max_mask then 'mask_ratio' end, case when cavity_ratio > max_cavity then 'large_cavity' end, case when bright_spots > max_spots then 'bright_spots' end, case when mirror_sim > max_mirror then 'bilateral_symmetry' end, case when hu_dist > max_hu then 'shape_hu' end, case when ref_z > max_z then 'off_real_distribution' end, case when ps_emd > max_ps_emd then 'psd_off_real' end] if x is not null] as legacy_reasons,
  [x for x in [case when modality_p < 0.85::double then 'MODALITY_LOW' end, case when center_overexposed then 'CENTER_OVEREXPOSED' end] if x is not null] as funnel_veto,
  [x for x in [case when mask_area_out then 'MASK_AREA_OUT_OF_DIST' end, case when not skin_line_present then 'SKIN_LINE_MISSING' end, case when closed_ring then 'CLOSED_RING_ARTIFACT' end, case when seam then 'GRID_SEAM' end] if x is not null] as soft_reasons from grouped),
judged as (select *, total_score >= 50 and not list_has_any(tags, [{hard}]) and len(group_veto) = 0 as stat_ok,
  round({_clip(f"case when modality_p is null and radiomics_score is null then 0.55::double + 0.45::double * {q} when mask_iou is null then 0.58::double * {p} + 0.42::double * {r} else 0.5::double * {p} + 0.35::double * {r} + 0.15::double * {_clip('mask_iou')} end - ({loss})")}, 13) as semantic_score from totalled),
reviewed as (select *, stat_ok and len(funnel_veto) = 0 as ok, cast(case when semantic_score > 0.8::double then 1 when semantic_score > 0.5::double then 2 else 3 end as int) as tier, round(case when semantic_score > 0.8::double then 0.6::double * semantic_score + 0.4::double * {q} else semantic_score * 0.3::double end, 14) as final_rank_score from judged)"""


REVIEWED = _chain()
B = "item_metrics"


@query("baseline_scalar_stats", f"with {STATS} select * from stats", B)
def baseline_scalar_stats(spark, sf_dir):
    return op.scalar_stats(load(spark, sf_dir, B).filter("is_real"))


@query("density_prior", f"with {PRIOR} select * from prior", B)
def density_prior(spark, sf_dir):
    return op.density_prior(load(spark, sf_dir, B).filter("is_real"))


CAL = ["min_mask", "max_mask", "min_circ", "max_circ", "max_mean", "mean_p1", "std_p99", "dr_p5", "ent_p95", "max_concavity", "max_perim", "max_round_density"]


@query("calibrate_thresholds", f"with {STATS}, {_threshold_sql()} select {', '.join(CAL)} from t", B)
def calibrate_thresholds(spark, sf_dir):
    real = load(spark, sf_dir, B).filter("is_real")
    return op.calibrated(op.baseline_row(op.scalar_stats(real), op.density_prior(real))).select(*[F.col("t")[k].alias(k) for k in CAL])


ARRIVALS = 4  # of two runs each
ARRIVED = f"""arrived as (select cast(substr(run_name, -1) as int) // 2 as arrival, {', '.join(f'cast({m} as double) as {m}' for m in op.METRICS)} from item_metrics where is_real),
grown as (select cast(a as int) as version, * from arrived, unnest({list(range(ARRIVALS))}) as t(a) where arrival <= a),
stats as (select version, metric, count(value) as n, {', '.join(f'round(quantile_cont(value, {q}), 9) as {p}' for p, q in op.POINTS.items())}, round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std
 from (unpivot grown on {', '.join(op.METRICS)} into name metric value value) group by version, metric)"""


def arrivals(spark, sf_dir):
    """A baseline of the real items and its four arrivals, one after the other."""
    real = load(spark, sf_dir, B).filter("is_real").withColumn("arrival", F.expr("cast(substr(run_name, -1) as int) div 2"))
    base = growing.GrowingBaseline(spark, scratch_path(spark, "growing"), op.METRICS)
    for a in range(ARRIVALS):
        base.add(real.filter(F.col("arrival") == a), f"runs-{a}")
        yield a, base


@query("baseline_growing", f"with {ARRIVED} select * from stats", B)
def baseline_growing(spark, sf_dir):
    """The exact baseline after each of four arrivals, without a second pass over what came before."""
    after = [stored(base.stats(), "growing-stats").withColumn("version", F.lit(a)) for a, base in arrivals(spark, sf_dir)]
    return functools.reduce(DataFrame.unionByName, after).select("version", "metric", "n", *op.POINTS, "mean", "std")


def _sources_sql() -> str:
    rows = [(k, f"'{m} {p}'") for k, (m, p) in op.CALIBRATED.items()]
    rows += [(k, f"case when value > {over} then '{m} p99' else 'default' end") for k, (m, over) in op.CALIBRATED_OVER.items()]
    return "case " + " ".join(f"when name = '{k}' then {v}" for k, v in rows) + " else 'default' end"


CHANGES = f"""with {ARRIVED}, {_threshold_sql("version")},
first as (select {', '.join(f'{op.DEFAULTS[op.STANDS_FOR.get(k, k)]}::double as {k}' for k in [*op.DEFAULTS, *op.STANDS_FOR])}),
every as (select cast(0 as bigint) as seq, name, value from (unpivot first on columns(*) into name name value value)
 union all select cast(version + 1 as bigint) as seq, name, value from (unpivot (select * from t) on columns(* exclude (version)) into name name value value)),
steps as (select *, lag(value) over (partition by name order by seq) as old from every)
select name as "limit", seq as valid_from, old, value as new, {_sources_sql()} as source from steps where seq > 0 and old is distinct from value"""


def threshold_history(spark, sf_dir):
    """Validity intervals of every limit: the defaults, then what each arrival of real items makes of them."""
    history = stored(growing.new_version(spark.createDataFrame([], growing.HISTORY), op.limit_rows(None, spark), 0), "threshold-history")
    for a, base in arrivals(spark, sf_dir):
        history = stored(growing.new_version(history, op.limit_rows(base.stats()), a + 1), "threshold-history")
    return history


@query("calibration_changes", CHANGES, B)
def calibration_changes(spark, sf_dir):
    """The record of changes: a row per limit and arrival that changed it."""
    return growing.change_record(threshold_history(spark, sf_dir)).filter("valid_from > 0")


@query("baseline_cross", f"with {REVIEWED} select item, max_mask, max_circ, ref_z from reviewed", B)
def baseline_cross(spark, sf_dir):
    return reviewed(spark, sf_dir).select("item", F.col("t.max_mask").alias("max_mask"), F.col("t.max_circ").alias("max_circ"), "ref_z")


@query("ref_z", f"with {REVIEWED} select item, ref_z from reviewed", B)
def ref_z(spark, sf_dir):
    return reviewed(spark, sf_dir).select("item", "ref_z")


@query("density_type", f"select item, {KIND} as density_type from item_metrics", B)
def density_type(spark, sf_dir):
    return load(spark, sf_dir, B).select("item", F.coalesce(bands.density_type(F.col("mean_intensity"), F.col("std_intensity")), F.lit("unknown")).alias("density_type"))


@query("double_band", "select item, round(" + _band("dynamic_range", "dr").replace("dr_p1", "0.25::double").replace("dr_p5", "0.35::double").replace("dr_p95", "0.95::double").replace("dr_p99", "1::double").replace("0.35::double5", "0.95::double").replace("0.95::double5", "0.95::double") + ", 9) as score from item_metrics", B)
def double_band(spark, sf_dir):
    return load(spark, sf_dir, B).select("item", F.round(bands.double_band(F.col("dynamic_range"), *[F.lit(x) for x in (0.25, 0.35, 0.95, 1.0)]), 9).alias("score"))


@query("grade_all", f"with {REVIEWED} select item, {', '.join(op.GRADES)}, array_to_string(tags, '|') as tags from reviewed", B)
def grade_all(spark, sf_dir):
    return reviewed(spark, sf_dir).select("item", *op.GRADES, F.array_join("tags", "|").alias("tags"))


#: The chain with limits of its own: pectorals required, groups failing under 0.6.
STRICT = REVIEWED.replace(f"{op.DEFAULTS['require_pectoral']}::double as require_pectoral", "1.0::double as require_pectoral").replace(f"{op.DEFAULTS['veto_group']}::double as veto_group", "0.6::double as veto_group")


@query("grade_required_pectoral", f"with {STRICT} select item, A3, list_contains(tags, 'NO_PECTORAL') as tagged, ok from reviewed", B)
def grade_required_pectoral(spark, sf_dir):
    rows = reviewed(spark, sf_dir, require_pectoral=1.0, veto_group=0.6)
    return rows.select("item", "A3", F.array_contains("tags", "NO_PECTORAL").alias("tagged"), "ok")


@query("score_total", f"with {REVIEWED} select item, group_A, group_B, group_C, group_D, group_E, group_F, total_score, array_to_string(group_veto, ',') as group_veto, array_to_string(legacy_reasons, '|') as legacy_reasons, stat_ok as ok from reviewed", B)
def score_total(spark, sf_dir):
    rows = items(spark, sf_dir)
    real = rows.filter("is_real")
    base = stored(op.baseline_row(op.scalar_stats(real), op.density_prior(real)), "baseline")
    done = op.totalled(op.graded(rows, op.calibrated(base)))
    return done.select("item", *[f"group_{g}" for g in "ABCDEF"], "total_score", F.array_join("group_veto", ",").alias("group_veto"), F.array_join("legacy_reasons", "|").alias("legacy_reasons"), "ok")


@query("stage1_funnel", f"with {REVIEWED} select item, array_to_string(funnel_veto, '|') as funnel_veto, array_to_string(soft_reasons, '|') as soft_reasons from reviewed", B)
def stage1_funnel(spark, sf_dir):
    return op.funnel(items(spark, sf_dir)).select("item", F.array_join("funnel_veto", "|").alias("funnel_veto"), F.array_join("soft_reasons", "|").alias("soft_reasons"))


@query("semantic_tier", f"with {REVIEWED} select item, semantic_score, tier, final_rank_score, ok from reviewed", B)
def semantic_tier(spark, sf_dir):
    return reviewed(spark, sf_dir).select("item", "semantic_score", "tier", "final_rank_score", "ok")


SUMMARY = """summary as (select run_name, count(*) as count, count(*) filter (where ok) as ok_count, round(count(*) filter (where ok) / count(*), 6) as pass_rate, round(avg(total_score), 4) as mean_total_score, round(avg(ps_slope), 4) as mean_ps_slope,
  coalesce(round(avg(brisque) filter (where brisque >= 0), 4), -1) as mean_brisque, count(*) filter (where len(group_veto) > 0) as veto_count, {g} from reviewed group by run_name)""".format(g=", ".join(f"round(avg(group_{x}), 6) as group_{x}" for x in "ABCDEF"))


@query("batch_summary", f"with {REVIEWED}, {SUMMARY} select * from summary", B)
def batch_summary(spark, sf_dir):
    return runs.batch_summary(reviewed(spark, sf_dir))


@query("violation_rates", f"with {REVIEWED}, sizes as (select run_name, count(*) as total from reviewed group by 1), tagged as (select run_name, unnest(tags) as tag from reviewed) select run_name, tag, count(*) as n, round(count(*) / max(total), 4) as rate from tagged join sizes using (run_name) group by 1, 2", B)
def violation_rates(spark, sf_dir):
    return runs.violation_rates(reviewed(spark, sf_dir))


@query("veto_by_group", f"with {STRICT}, v as (select run_name, unnest(group_veto) as veto from reviewed) select run_name, veto, count(*) as n from v group by 1, 2", B)
def veto_by_group(spark, sf_dir):
    """With the stricter limit, under which groups of these items fail."""
    return reviewed(spark, sf_dir, require_pectoral=1.0, veto_group=0.6).select("run_name", F.explode("group_veto").alias("veto")).groupBy("run_name", "veto").agg(F.count("*").alias("n"))


@query("tier_hist", f"with {REVIEWED} select run_name, tier, count(*) as n from reviewed group by 1, 2", B)
def tier_hist(spark, sf_dir):
    return reviewed(spark, sf_dir).groupBy("run_name", "tier").agg(F.count("*").alias("n"))


@query("run_metrics_by_tier", f"with {REVIEWED} select run_name, count(*) as n, round(avg(case when tier = 1 then 1.0 else 0 end), 6) as tier1_ratio, round(avg(semantic_score), 6) as mean_semantic, round(avg(total_score), 6) as mean_quality, round(avg(case when ok then 1.0 else 0 end), 6) as pass_rate from reviewed group by 1", B)
def run_metrics_by_tier(spark, sf_dir):
    return runs.metrics_by_tier(reviewed(spark, sf_dir))


@query("topk_ranked", f"with {REVIEWED}, r as (select run_name, item, tier, final_rank_score, total_score, cast(row_number() over (partition by run_name order by tier, final_rank_score desc, total_score desc, item) as int) as rank from reviewed where ok) select * from r where rank <= 30", B)
def topk_ranked(spark, sf_dir):
    return runs.top_ranked(review_table(spark, sf_dir, "run_name", "item", "ok", "tier", "final_rank_score", "total_score").filter("ok"), 30)


@query("preview_rank", f"with {REVIEWED}, r as (select run_name, item, ok, tier, total_score, cast(row_number() over (partition by run_name order by ok desc, tier, total_score desc, item) as int) as rank from reviewed) select * from r where rank <= 12", B)
def preview_rank(spark, sf_dir):
    return runs.preview(reviewed(spark, sf_dir), 12)


@query("topk_with_mapping", f"with {REVIEWED}, m as (select distinct l_partkey as part, 'src_' || l_partkey as source from lineitem where l_partkey % 3 = 0), r as (select item, cast(split_part(item, '-', 3) as bigint) as part, total_score from reviewed) select item, source, total_score from r join m using (part) order by total_score desc, item limit 50", B)
def topk_with_mapping(spark, sf_dir):
    mapping = load(spark, sf_dir, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_partkey").alias("part"), F.concat(F.lit("src_"), F.col("l_partkey").cast("string")).alias("source")).distinct()
    rows = reviewed(spark, sf_dir).select("item", F.element_at(F.split("item", "-"), 3).cast("long").alias("part"), "total_score")
    return rows.join(mapping, "part").select("item", "source", "total_score").orderBy(F.desc("total_score"), "item").limit(50)


@query("gallery_scores_join", f"with {REVIEWED}, p as (select item, tier, final_rank_score from reviewed where bright_spots % 3 > 0) select i.item, coalesce(p.tier, 4) as tier, coalesce(p.final_rank_score, 0) as final_rank_score from item_metrics i left join p using (item)", B)
def gallery_scores_join(spark, sf_dir):
    scores = reviewed(spark, sf_dir).filter("bright_spots % 3 > 0").select("item", "tier", "final_rank_score")
    return load(spark, sf_dir, B).select("item").join(scores, "item", "left").select("item", F.coalesce("tier", F.lit(4)).alias("tier"), F.coalesce("final_rank_score", F.lit(0.0)).alias("final_rank_score"))


@query("lesion_gate", "with r as (select item, run_name, row_number() over (partition by run_name order by item) as rank from item_metrics where not (round_isolated > 6 or edge_voids_px > 200 or bright_spots >= 4)) select run_name, item, cast(rank as int) as rank from r where rank <= 20", B)
def lesion_gate(spark, sf_dir):
    return runs.lesion_gate(load(spark, sf_dir, B).selectExpr("*", "case when round_isolated > 6 then 1 else 0 end as mass_count", "case when edge_voids_px > 200 then 1 else 0 end as cluster_count", "bright_spots as calc_dots"), 20)


SOURCES = "sources as (select item, run_name, mask_ratio as area_frac, circularity, cavity_ratio as convex_defect, 1 + mirror_sim as aspect, bright_spots as bg_count, std_intensity / 10 as bg_frac, round_isolated as dots, edge_voids_px % 12 as marker_score, case when edge_voids_px % 7 = 0 then null else local_entropy * 6 end as lap_p75, mean_intensity * 40 as grad_p75, case when round_isolated = 8 then 1 else 0 end as mass_count, case when edge_voids_px > 240 then 1 else 0 end as cluster_count, round_isolated % 7 as calc_dots from item_metrics)"
SCORE = "round(area_frac * 1.2::double + circularity * 0.35::double - convex_defect * 0.45::double - abs(aspect - 1.55::double) * 0.08::double - (bg_count * 0.18::double + bg_frac * 60) - greatest(0, dots - 3) * 0.06::double, 6)"
BURDEN = "(marker_score >= 8 or bg_count >= 20 or bg_frac >= 0.018::double or dots >= 10 or coalesce(lap_p75 < 14 or (lap_p75 is not null and grad_p75 < 14), false) or mass_count > 0 or cluster_count > 0 or calc_dots >= 6)"
SHAPE_BAD = "coalesce(area_frac < 0.08::double or area_frac > 0.85::double or circularity < 0.3::double or convex_defect > 0.45::double or aspect > 2.2::double, false)"


def sources(spark, sf_dir):
    return load(spark, sf_dir, B).selectExpr(
        "item", "run_name", "mask_ratio as area_frac", "circularity", "cavity_ratio as convex_defect", "1 + mirror_sim as aspect", "bright_spots as bg_count", "std_intensity / 10 as bg_frac", "round_isolated as dots", "edge_voids_px % 12 as marker_score",
        "case when edge_voids_px % 7 = 0 then null else local_entropy * 6 end as lap_p75", "mean_intensity * 40 as grad_p75", "case when round_isolated = 8 then 1 else 0 end as mass_count", "case when edge_voids_px > 240 then 1 else 0 end as cluster_count", "round_isolated % 7 as calc_dots",
    )


@query("source_quality_score", f"with {SOURCES} select item, {SCORE} as score from sources", B)
def source_quality_score(spark, sf_dir):
    return sources(spark, sf_dir).select("item", F.round(bands.source_quality_score(), 6).alias("score"))


@query("artifact_burden", f"with {SOURCES} select item, {BURDEN} as burdened from sources", B)
def artifact_burden(spark, sf_dir):
    return sources(spark, sf_dir).select("item", bands.artifact_burden().alias("burdened"))


@query("filter_shape", f"with {SOURCES} select item from sources where not {SHAPE_BAD}", B)
def filter_shape(spark, sf_dir):
    return runs.filter_shape(sources(spark, sf_dir)).select("item")


POOL = f"{SOURCES}, pool as (select item, {SCORE} as score, case when {BURDEN} then 1 else 0 end as priority from sources where not {SHAPE_BAD}), good as (select count(*) as n from pool where priority = 0)"


@query("source_pool_topn", f"with {POOL} select item, score, priority from pool order by priority, score desc, item limit 500", B)
def source_pool_topn(spark, sf_dir):
    return runs.source_pool(sources(spark, sf_dir), 500)


@query("union_with_fallback", f"with {POOL}, f as (select item, row_number() over (order by score desc, item) as k from pool where priority = 1) select item, 0 as priority from pool where priority = 0 union all select item, 1 from f where k <= (select greatest(0, 40000 - n) from good)", B)
def union_with_fallback(spark, sf_dir):
    return runs.with_fallback(sources(spark, sf_dir), 40_000)


@query("seeded_sample", "select item, run_name from item_metrics order by md5('2026|' || item), item limit 300", B)
def seeded_sample(spark, sf_dir):
    return runs.seeded_sample(load(spark, sf_dir, B).select("item", "run_name"), "item", 300, 2026)


@query("sink_baseline", f"with {STATS} select metric, p1, p5, p50, p95, p99, mean, std from stats", B)
def sink_baseline(spark, sf_dir):
    """The baseline as one JSON row, read back with its schema."""
    real = load(spark, sf_dir, B).filter("is_real")
    row = op.baseline_row(op.scalar_stats(real), op.density_prior(real))
    path = scratch_path(spark, "baseline-json")
    row.write.json(path)
    back = spark.read.schema(row.schema).json(path)
    return back.select(F.explode("stats").alias("metric", "s")).select("metric", "s.*")


@query("scan_baseline", f"with {PRIOR} select density_type, prior from prior", B)
def scan_baseline(spark, sf_dir):
    """The stored baseline's prior, read without its other maps; a missing key is null."""
    real = load(spark, sf_dir, B).filter("is_real")
    row = op.baseline_row(op.scalar_stats(real), op.density_prior(real))
    path = scratch_path(spark, "baseline-json")
    row.write.json(path)
    back = spark.read.schema("prior map<string,double>, other map<string,double>").json(path)
    return back.filter("other is null").select(F.explode("prior").alias("density_type", "prior"))


@query("sink_review_report", f"with {REVIEWED} select item, cast(ok as varchar) as ok, cast(tier as varchar) as tier, coalesce(cast(modality_p is not null as varchar), '') as measured, case when len(tags) > 0 then array_to_string(tags, '|') else 'pass' end as tags from reviewed", B)
def sink_review_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    runs.report(reviewed(spark, sf_dir)).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema=runs.REPORT_SCHEMA, emptyValue="").select("item", "ok", "tier", (F.col("modality_p").isNotNull()).cast("string").alias("measured"), "tags")
