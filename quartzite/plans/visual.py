"""Queries over components, pixel tables and images, and the incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as comp
from ..operators import images, pixels, validation
from ..sources.adapters import load
from ..sources.scratch import scratch_path, stored
from ..streaming.ingest import ingest
from .registry import query

I = "components"  # noqa: E741
P = "p as (select *, x + w / 2 as cx, y + h / 2 as cy from components)"
GAP = "(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2))"


@query("components_isolated", f"with {P}, n as (select a.image_id, a.comp_id, min(case when a.comp_id <> b.comp_id then {GAP} end) as g from p a join p b using (image_id) group by 1, 2) select image_id, count(*) filter (where coalesce(g > 3600, true)) as isolated from n group by 1", I)
def components_isolated(spark, sf_dir):
    return comp.isolated(load(spark, sf_dir, I))


@query("components_clusters", f"with {P}, n as (select a.image_id, a.comp_id, count(*) as n from p a join p b using (image_id) where {GAP} <= 160 * 160 group by 1, 2) select image_id, cast(max(case when n >= 4 then 1 else 0 end) as int) as clustered from n group by 1", I)
def components_clusters(spark, sf_dir):
    return comp.clusters(load(spark, sf_dir, I), F.lit(160 / 0.055))


BOXES = "b as (select image_id, comp_id, x, y, w * 5 as w, h * 6 as h from components)"
STRIPS = "s as (select * from (values (0, 0, 480, 106), (0, 374, 480, 480), (0, 0, 106, 480), (374, 0, 480, 480)) t(sx1, sy1, sx2, sy2))"
CUTS = f"{BOXES}, {STRIPS}, c as (select b.*, count(*) filter (where least(x + w, sx2) > greatest(x, sx1) + 1 and least(y + h, sy2) > greatest(y, sy1) + 1) as rects from b cross join s group by all), o as (select *, case when w * h > 0.052 * 480 * 480 then 'skipped_area' when w > 0.36 * 480 or h > 0.36 * 480 then 'skipped_side' when rects = 0 then 'skipped_no_margin' else 'painted' end as outcome from c)"


@query("boxes_x_strips", f"with {CUTS} select outcome, count(*) as boxes, cast(sum(case when outcome = 'painted' then rects else 0 end) as bigint) as rects from o group by 1", I)
def boxes_x_strips(spark, sf_dir):
    boxes = load(spark, sf_dir, I).withColumns({"w": F.col("w") * 5, "h": F.col("h") * 6})
    rows = comp.strips(boxes, 480, 480)
    return rows.groupBy("outcome").agg(F.count("*").alias("boxes"), F.sum(F.when(F.col("outcome") == "painted", F.size("rects")).otherwise(0)).alias("rects"))


@query(
    "component_counts",
    """select image_id, count(*) as n, max(area) as largest, count(*) filter (where area between 5 and 220) as bright_spots, count(*) filter (where area between 20 and 800 and least(w, h) >= 3 and least(w, h) / greatest(w, h) >= 0.6) as round,
 cast(coalesce(sum(area) filter (where area between 20 and 800 and least(w, h) >= 3 and least(w, h) / greatest(w, h) >= 0.6), 0) as bigint) as round_area, count(*) filter (where area between 13 and 255 and least(w, h) / greatest(w, h) < 0.26) as elong_bright, count(*) filter (where area between 18 and 380 and least(w, h) / greatest(w, h) < 0.26) as elong_dark,
 count(*) filter (where area <= 140) as tiny, count(*) filter (where area between 8 and 800) as markers, count(*) filter (where area between 3 and 90 and greatest(w, h) <= 14) as dots, count(*) filter (where area between 8 and 13824 and least(w, h) >= 3) as background from components group by 1""",
    I,
)
def component_counts(spark, sf_dir):
    return comp.counts(load(spark, sf_dir, I))


SCORES = f"{P}, r as (select *, row_number() over (partition by image_id order by area desc, comp_id) as rk, max(area) over (partition by image_id) as biggest, cx < 134.4 or cx >= 345.6 or cy < 134.4 or cy >= 345.6 as margin from p), l as (select image_id, count(*) filter (where rk > 1 and area <= biggest * 0.3::double and ((margin and area >= 12) or (not margin and area >= 36))) as suspicious from r group by 1), sc as (select *, least(1.0::double, suspicious / 3) as score from l)"


@query(
    "label_verdict",
    f"with {SCORES} select image_id, suspicious, round(score, 6) as score, case when score <= 0.2::double then 'certain_clean' when score >= 0.65::double then 'certain_labeled' else 'uncertain' end as verdict, round(case when score <= 0.2::double then 1 - score / 0.2::double when score >= 0.65::double then (score - 0.65::double) / (1 - 0.65::double) else 1 - least(score - 0.2::double, 0.65::double - score) / ((0.65::double - 0.2::double) / 2) end, 6) as confidence from sc",
    I,
)
def label_verdict(spark, sf_dir):
    name, conf = comp.verdict(F.col("score"))
    return comp.label_scores(load(spark, sf_dir, I)).select("image_id", "suspicious", F.round("score", 6).alias("score"), name.alias("verdict"), F.round(conf, 6).alias("confidence"))


VERDICTS = f"{SCORES}, v as (select image_id, case when score <= 0.2::double then 'certain_clean' when score >= 0.65::double then 'certain_labeled' else 'uncertain' end as verdict from sc)"


@query("label_action_counts", f"with {VERDICTS} select case when image_id % 19 = 0 then 'unreadable' when verdict = 'certain_clean' then 'certain_clean' when verdict = 'certain_labeled' then 'certain_labeled_strip' else 'fallback_strip_uncertain' end as action, count(*) as n from v group by 1", I)
def label_action_counts(spark, sf_dir):
    name, _ = comp.verdict(F.col("score"))
    rows = comp.label_scores(load(spark, sf_dir, I))
    return rows.groupBy(comp.label_action(name, F.col("image_id") % 19 != 0).alias("action")).agg(F.count("*").alias("n"))


DRAWS = f"{VERDICTS}, d as (select *, image_id % 300 as slot, row_number() over (partition by image_id % 300 order by md5('42|' || image_id), image_id) as draw from v)"


@query(
    "candidate_retry",
    f"with {DRAWS}, t as (select *, min(case when verdict <> 'uncertain' then draw end) over (partition by slot) as first, max(draw) over (partition by slot) as last from d where draw <= 5) select slot, image_id, case when first is null then 'fallback_strip_uncertain' else verdict end as action from t where draw = coalesce(first, last)",
    I,
)
def candidate_retry(spark, sf_dir):
    """Slots draw from the images that share a remainder, in hash order, up to five times."""
    from pyspark.sql import Window

    from ..operators.captions import hash_order

    name, _ = comp.verdict(F.col("score"))
    rows = comp.label_scores(load(spark, sf_dir, I)).select("image_id", name.alias("verdict"), (F.col("image_id") % 300).alias("slot"))
    w = Window.partitionBy("slot").orderBy(hash_order(F.col("image_id"), "42"), "image_id")
    draws = rows.withColumn("draw", F.row_number().over(w)).filter("draw <= 5")
    return validation.settled_slots(draws, ["slot"], "draw", "verdict", ("certain_clean", "certain_labeled")).select("slot", "image_id", "action")


@query(
    "anatomy_chaos_score",
    """with c as (select image_id, max(area) as largest, sum(area) as total, count(*) filter (where area between 13 and 255 and least(w, h) / greatest(w, h) < 0.26) as eb, count(*) filter (where area between 18 and 380 and least(w, h) / greatest(w, h) < 0.26) as ed, count(*) filter (where area <= 140) as tiny, count(*) as n from components group by 1),
f as (select image_id, least(1.0::double, (eb * 2.2::double + ed * 1.5::double + tiny * 0.3::double) / greatest(1.0::double, sqrt(total))) as frag, image_id % 11 / 10.0::double as mirror, image_id % 9 * 1.0::double as hu, n / 100.0::double as edges, image_id % 5 / 10.0::double as risk from c)
select image_id, round(greatest(0::double, least(1::double, frag * 0.35::double + greatest(0::double, 0.5::double - mirror) * 2 * 0.2::double + least(1::double, hu / 8) * 0.15::double + least(1::double, edges * 3) * 0.1::double + risk * 0.2::double + greatest(0::double, greatest(0::double, 0.55::double - mirror) * 3 - 0.4::double) * 0.15::double)), 6) as chaos from f""",
    I,
)
def anatomy_chaos_score(spark, sf_dir):
    rows = load(spark, sf_dir, I)
    c = comp.counts(rows).join(rows.groupBy("image_id").agg(F.sum("area").alias("total")), "image_id")
    n = F.col("image_id")
    score = comp.chaos(F.col("total"), n % 11 / 10.0, (n % 9) * 1.0, F.col("n") / 100.0, n % 5 / 10.0)
    return c.select("image_id", F.round(score, 6).alias("chaos"))


@query(
    "text_boxes",
    "with m as (select *, max(area) over (partition by image_id) as biggest from components) select image_id, comp_id, greatest(0, x - 6) as x1, greatest(0, y - 6) as y1, least(480, x + w + 6) as x2, least(480, y + h + 6) as y2 from m where area >= 12 and area <= biggest * 0.3::double and not (area > 200 and greatest(w, h) / greatest(1, least(w, h)) < 2)",
    I,
)
def text_boxes(spark, sf_dir):
    return comp.text_boxes(load(spark, sf_dir, I), most=0.3)


@query("text_box_share", "with m as (select *, max(area) over (partition by image_id) as biggest from components), b as (select distinct image_id from m where area >= 12 and area <= biggest * 0.3::double and not (area > 200 and greatest(w, h) / greatest(1, least(w, h)) < 2)), c as (select (select count(distinct image_id) from components) as images, (select count(*) from b) as with_boxes) select *, round(with_boxes / images, 6) as share from c", I)
def text_box_share(spark, sf_dir):
    return comp.share_with_boxes(load(spark, sf_dir, I), most=0.3)


BOX = "case image_id % 3 when 0 then concat('found [{\"x1\": ', x, ', \"y1\": ', y, ', \"x2\": ', x + w * 9 + 101, ', \"y2\": ', y + h, '}] ok') when 1 then concat('[{\"left\": ', x % 90, ', \"top\": ', y % 80, ', \"right\": ', x % 90 + 8, ', \"bottom\": ', y % 80 + 3, '}]') else 'none' end"


@query(
    "boxes_from_json",
    """with b as (select image_id, comp_id, x, y, x + w * 9 + 101 as x2, y + h as y2 from components where image_id % 3 = 0),
px as (select image_id, comp_id, least(x, 479) as a_x, least(y, 479) as a_y, least(x2, 480) as b_x, least(y2, 480) as b_y from b),
pc as (select image_id, comp_id, cast(floor((x % 90) / 100.0::double * 480) as int) as a_x, cast(floor((y % 80) / 100.0::double * 480) as int) as a_y, least(480, cast(floor((x % 90 + 8) / 100.0::double * 480) as int)) as b_x, least(480, cast(floor((y % 80 + 3) / 100.0::double * 480) as int)) as b_y from components where image_id % 3 = 1),
u as (select * from px union all select * from pc)
select image_id, comp_id, cast(least(a_x, b_x) as int) as x1, cast(least(a_y, b_y) as int) as y1, cast(greatest(a_x, b_x) as int) as x2, cast(greatest(a_y, b_y) as int) as y2 from u where a_x <> b_x and a_y <> b_y""",
    I,
)
def boxes_from_json(spark, sf_dir):
    rows = load(spark, sf_dir, I).selectExpr("image_id", "comp_id", f"{BOX} as reply")
    boxes = rows.select("image_id", "comp_id", F.explode(comp.boxes_from_json(F.col("reply"))).alias("b")).select("image_id", "comp_id", "b.*")
    return comp.scaled_boxes(boxes, 480, 480)


# ---- pixel tables

TI = "tiles"
MASKED = "m as (select * from tiles where v >= 118)"


def masked(spark, sf_dir):
    return load(spark, sf_dir, TI).filter("v >= 118")


@query(
    "mask_histogram_stats",
    f"with {MASKED} select image_id, round(avg(v) / 255, 6) as mean, round(stddev_pop(v) / 255, 6) as std, round((quantile_cont(v, 0.99) - quantile_cont(v, 0.01)) / 255, 6) as dynamic_range, round(avg(case when v / 255 > 0.9 then 1.0 else 0 end), 6) as bright, round(avg(case when v / 255 < 0.1 then 1.0 else 0 end), 6) as dark from m group by 1",
    TI,
)
def mask_histogram_stats(spark, sf_dir):
    return pixels.histogram_stats(masked(spark, sf_dir))


@query(
    "banding_score",
    f"""with {MASKED}, y as (select image_id, y as k, var_pop(v) as var from m group by 1, 2 having count(*) >= 3), x as (select image_id, x as k, var_pop(v) as var from m group by 1, 2 having count(*) >= 3),
ys as (select image_id, count(*) as n, count(*) filter (where var < 0.15 * med or var > 6 * med) as odd from (select *, median(var) over (partition by image_id) as med from y) group by 1),
xs as (select image_id, count(*) as n, count(*) filter (where var < 0.15 * med or var > 6 * med) as odd from (select *, median(var) over (partition by image_id) as med from x) group by 1)
select i.image_id, round(coalesce(case when ys.n < 4 or xs.n < 4 then 1 else greatest(0, 1 - (ys.odd + xs.odd) / greatest(8, 0.05 * (ys.n + xs.n))) end, 1), 6) as banding from (select distinct image_id from m) i left join ys using (image_id) left join xs using (image_id)""",
    TI,
)
def banding_score(spark, sf_dir):
    return pixels.banding(masked(spark, sf_dir), least=3, least_lines=4, floor=8.0).withColumn("banding", F.round("banding", 6))


@query(
    "otsu_threshold",
    "with h as (select image_id, v, count(*) as n from tiles group by 1, 2), r as (select *, sum(n) over w0 as w0, sum(n * v) over w0 as s0, sum(n) over w as w, sum(n * v) over w as s from h window w0 as (partition by image_id order by v), w as (partition by image_id)), b as (select image_id, v, round(w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2), 6) as between_ from r where w0 < w), k as (select *, row_number() over (partition by image_id order by between_ desc, v) as rk from b) select image_id, v as threshold from k where rk = 1",
    TI,
)
def otsu_threshold(spark, sf_dir):
    return pixels.otsu(load(spark, sf_dir, TI))


@query("mirror_similarity", "with z as (select *, x < 4 as side, (v - avg(v) over w) / (stddev_pop(v) over w + 1e-6::double) as z from tiles window w as (partition by image_id, x < 4)) select l.image_id, round(avg(l.z * r.z), 6) as mirror from z l join z r on l.image_id = r.image_id and l.y = r.y and l.x = 7 - r.x where l.side group by 1", TI)
def mirror_similarity(spark, sf_dir):
    return pixels.mirror_similarity(load(spark, sf_dir, TI), 8).withColumn("mirror", F.round("mirror", 6))


@query("winsorize", "with e as (select image_id, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from tiles group by 1) select image_id, y, x, case when hi <= lo then v else cast(floor(round((greatest(lo, least(hi, v)) - lo) / (hi - lo) * 255, 6)) as int) end as v from tiles join e using (image_id)", TI)
def winsorize(spark, sf_dir):
    return pixels.winsorized(load(spark, sf_dir, TI), 0.02, 0.98)


MATCH = """rh as (select v, sum(count(*)) over (order by v) / sum(count(*)) over () as q from tiles where image_id % 50 = 0 group by v),
oh as (select image_id, v, sum(count(*)) over (partition by image_id order by v) / sum(count(*)) over (partition by image_id) as q from tiles group by 1, 2),
e as (select o.image_id, o.v, o.q, (select min(struct_pack(q := r.q, v := r.v)) from rh r where r.q >= o.q - 1e-12::double) as hi, (select max(struct_pack(q := r.q, v := r.v)) from rh r where r.q < o.q - 1e-12::double) as lo from oh o),
t as (select image_id, v, round(0.4::double * v + 0.6::double * case when lo is null then hi.v when hi is null then lo.v else lo.v + (hi.v - lo.v) * (q - lo.q) / (hi.q - lo.q) end, 6) as new from e)"""


@query("histogram_match", f"with {MATCH} select tiles.image_id, y, x, new as v from tiles join t on tiles.image_id = t.image_id and tiles.v = t.v", TI)
def histogram_match(spark, sf_dir):
    rows = load(spark, sf_dir, TI)
    return pixels.matched(rows, rows.filter("image_id % 50 = 0"), 0.6)


@query("center_exposure", "select image_id, round(avg(case when v >= 150 then 1.0 else 0 end), 6) as share, avg(case when v >= 150 then 1.0 else 0 end) > 0.3 as overexposed from tiles where x between 2 and 5 and y between 2 and 5 group by 1", TI)
def center_exposure(spark, sf_dir):
    return pixels.center_overexposed(load(spark, sf_dir, TI), 8, 8, bright=150).withColumn("share", F.round("share", 6))


@query(
    "bright_orientation",
    f"""with {MASKED}, c as (select image_id, quantile_cont(v, 0.6) as cut from m group by 1), b as (select m.image_id, count(*) as n, var_samp(x) as a, var_samp(y) as d, covar_samp(x, y) as b, avg(case when x between 3 and 4 then 1.0 else 0 end) as central from m join c using (image_id) where v >= cut group by 1),
e as (select *, greatest(1e-6, (a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b)) as big, greatest(1e-6, (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b)) as small from b)
select image_id, round(sqrt(big / small), 6) as elongation, round(central, 6) as central, round(case when n < 5 then 1 else greatest(0, least(1, 1 - (greatest(0, ((case when abs(b) < 1e-12 and a >= d then 90 when abs(b) < 1e-12 then 0 else degrees(atan2(abs(b), abs(big - a))) end) - 60) / 30) * 0.4 + greatest(0, (sqrt(big / small) - 2) / 4) * 0.4 + greatest(0, (central - 0.3) / 0.4) * 0.2))) end, 6) as score from e""",
    TI,
)
def bright_orientation(spark, sf_dir):
    return pixels.orientation(masked(spark, sf_dir), 8, percentile=0.6, least=5)


@query("mask_iou", "with a as (select image_id // 2 as pair, y, x from tiles where image_id % 2 = 0 and v >= 118), b as (select image_id // 2 as pair, y, x from tiles where image_id % 2 = 1 and v >= 118) select coalesce(a.pair, b.pair) as pair, round(count(*) filter (where a.pair is not null and b.pair is not null) / (count(*) + 1e-6::double), 6) as iou from a full join b on a.pair = b.pair and a.y = b.y and a.x = b.x group by 1", TI)
def mask_iou(spark, sf_dir):
    rows = masked(spark, sf_dir)
    side = lambda k: rows.filter(F.col("image_id") % 2 == k).select(F.floor(F.col("image_id") / 2).alias("pair"), "y", "x")
    return pixels.mask_iou(side(0), side(1)).select("pair", F.round("iou", 6).alias("iou"))


STATUS = "r as (select image_id, case when image_id % 13 = 0 then 0::double else avg(case when v >= 118 then 1.0 else 0 end) end as mask_ratio, image_id % 7 = 0 as exists_ from tiles group by 1), st as (select *, case when exists_ then 'pre_existing' when mask_ratio = 0 then 'read_failed' when mask_ratio < 0.55::double or mask_ratio > 0.8::double then 'mask_ratio_out_of_range' else 'ok' end as status from r)"


def statuses(spark, sf_dir):
    rows = load(spark, sf_dir, TI).groupBy("image_id").agg(F.avg(F.when(F.col("v") >= 118, 1.0).otherwise(0.0)).alias("mask_ratio"))
    n = F.col("image_id")
    return pixels.mask_status(rows.withColumns({"mask_ratio": F.when(n % 13 == 0, 0.0).otherwise(F.col("mask_ratio")), "exists": n % 7 == 0}), low=0.55)


@query("filter_mask_ratio", f"with {STATUS} select image_id, round(mask_ratio, 6) as mask_ratio from st where status = 'ok'", TI)
def filter_mask_ratio(spark, sf_dir):
    return statuses(spark, sf_dir).filter("status = 'ok'").select("image_id", F.round("mask_ratio", 6).alias("mask_ratio"))


@query("mask_outcome_counts", f"with {STATUS} select status, count(*) as n from st group by 1", TI)
def mask_outcome_counts(spark, sf_dir):
    return statuses(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("sink_mask_meta", f"with {STATUS} select case when status = 'ok' then 'meta' else 'skipped' end as log, status, count(*) as n from st where status <> 'pre_existing' group by 1, 2", TI)
def sink_mask_meta(spark, sf_dir):
    rows = stored(statuses(spark, sf_dir), "statuses")
    path = scratch_path(spark, "masks")
    rows.filter("status = 'ok'").write.json(f"{path}/meta")
    rows.filter("status in ('read_failed', 'mask_ratio_out_of_range')").write.json(f"{path}/skipped")
    back = lambda log: spark.read.schema("image_id long, mask_ratio double, status string").json(f"{path}/{log}").groupBy(F.lit(log).alias("log"), "status").agg(F.count("*").alias("n"))
    return back("meta").union(back("skipped"))


@query("skip_existing_anti", "select distinct image_id from tiles where image_id % 3 > 0", TI)
def skip_existing_anti(spark, sf_dir):
    inputs = load(spark, sf_dir, TI).select("image_id").distinct()
    done = inputs.filter("image_id % 3 = 0")
    return inputs.join(done, "image_id", "left_anti")


# ---- images

def tiled(spark, sf_dir):
    return images.tiled(load(spark, sf_dir, "profiles"))


LINES = "select image_id, {k} * 8 + r as pos, round(var_pop(v), 6) as value from m, (select unnest(range(8)) as r) group by 1, {k}, r"


@query(
    "image_pixels_hist",
    f"with {MASKED} select image_id, 'value' as kind, v as pos, cast(64 * count(*) as double) as value from m group by 1, 3 union all select image_id, 'row', cast(pos as int), value from ({LINES.format(k='y')}) union all select image_id, 'column', cast(pos as int), value from ({LINES.format(k='x')})",
    TI,
)
def image_pixels_hist(spark, sf_dir):
    """Each image's masked histogram and the masked variance of its rows and columns, a row per number."""
    rows = images.pixels_hist(tiled(spark, sf_dir), images.over(118))
    part = lambda kind, c: rows.select("image_id", F.lit(kind).alias("kind"), F.posexplode(c).alias("pos", "value"))
    return part("value", F.transform("hist", lambda n: n.cast("double"))).filter("value > 0").union(part("row", "row_var").union(part("column", "col_var")).filter("value is not null").withColumn("value", F.round("value", 6)))


@query("scan_images", "select concat(image_id, '.png') as name, 64 as height, 64 as width, false as read_failed, cast(64 * sum(v) as bigint) as total from tiles group by image_id", TI)
def scan_images(spark, sf_dir):
    """Every tile as an image file, found and decoded again."""
    path = scratch_path(spark, "images")
    images.write_files(tiled(spark, sf_dir), path)
    return images.pixel_totals(images.scan(spark, path)).select("name", "height", "width", "read_failed", "total")


@query("image_components")
def image_components(spark, sf_dir):
    return images.components(tiled(spark, sf_dir)).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query("image_spectrum")
def image_spectrum(spark, sf_dir):
    return images.spectrum(tiled(spark, sf_dir)).select("image_id", "bin", F.round("share", 6).alias("share"))


@query("ps_slope")
def ps_slope(spark, sf_dir):
    return images.power_slopes(tiled(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


@query("seam_peaks")
def seam_peaks(spark, sf_dir):
    return images.seams(tiled(spark, sf_dir))


@query("image_gradient_hist")
def image_gradient_hist(spark, sf_dir):
    return images.gradient_hist(tiled(spark, sf_dir)).select("image_id", F.posexplode("hist").alias("bin", "share")).withColumn("share", F.round("share", 6))


@query("grid_periodicity")
def grid_periodicity(spark, sf_dir):
    return images.periodicity(tiled(spark, sf_dir))


@query("incremental_ingest", "with l as (select line, source_tag, score, recorded_at from history) select source_tag, count(*) as n, round(sum(score), 4) as score from l group by 1", "history")
def incremental_ingest(spark, sf_dir):
    """Two arrivals of files, each ingested once by the same job."""
    rows = load(spark, sf_dir, "history")
    base = scratch_path(spark, "ingest")
    for k in (0, 1):
        rows.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{base}/in")
        ingest(spark, f"{base}/in", rows.schema, lambda b: b.select("source_tag", "score"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("source_tag string, score double").parquet(f"{base}/out").groupBy("source_tag").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))
