"""Queries over the catalogue: scans, predicates, lookups, joins, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog as op
from ..sources import readers
from ..sources.adapters import load
from ..sources.bucketed import bucketed, buckets_for, joined
from ..sources.scratch import scratch_path
from .registry import query

CASES = """
cases as (select trim(patient_id) as patient_id, upper(trim(side)) as laterality, upper(trim(view_raw)) as view, file_ord, row_ord,
  case trim(density_code) when '1' then 'fatty' when '2' then 'scattered' when '3' then 'heterogeneous' when '4' then 'dense' end as density from case_desc),
lookup as (select patient_id, laterality, view, arg_max(density, cast(file_ord as bigint) * 1000000000 + row_ord) as density from cases where density is not null and view in ('CC', 'MLO') group by 1, 2, 3)"""
SERIES = r"""
series as (select *, regexp_extract(series_id, '(?i)(P_\d+)_(LEFT|RIGHT)_(CC|MLO)', 1) as patient_id,
  upper(regexp_extract(series_id, '(?i)(P_\d+)_(LEFT|RIGHT)_(CC|MLO)', 2)) as laterality, upper(regexp_extract(series_id, '(?i)(P_\d+)_(LEFT|RIGHT)_(CC|MLO)', 3)) as view
  from catalog where modality = 'MG' and lower(trim(series_description)) like '%full mammogram%' and regexp_matches(series_id, '(?i)(P_\d+)_(LEFT|RIGHT)_(CC|MLO)'))"""
QUALITY = """
measured as (select s.*, l.density, row_ord % 23 <> 0 as has_file, case when row_ord % 41 = 0 then null else s.height end as h0,
   (row_ord % 101) / 100.0::double as mask_ratio, (row_ord % 103) * 100 as mask_pixels, (row_ord % 13) / 200.0::double as bright0, (row_ord % 19) / 250.0::double as dark0, row_ord % 11 <> 0 as skin_line, row_ord % 47 as marker_score
  from series s left join lookup l using (patient_id, laterality, view)),
ruled as (select *, case when h0 is null then ['read_failed'] else list_filter_null([
   case when greatest(h0, width) < 1200 or least(h0, width) < 700 then 'too_small_or_cropped' end,
   case when mask_ratio < 0.03 or mask_ratio > 0.90 then 'mask_ratio_out_of_range' end,
   case when mask_pixels < 1000 then 'empty_breast_mask' end,
   case when mask_pixels >= 1000 and bright0 > 0.05 then 'overexposed' end,
   case when mask_pixels >= 1000 and dark0 > 0.05 then 'underexposed' end,
   case when not skin_line then 'skin_line_missing' end,
   case when marker_score > 40 then 'marker_or_ruler_heavy' end]) end as quality from measured),
checked as (select *, case when density is null then ['missing_density'] when not has_file then ['missing_file'] else quality end as reasons from ruled)""".replace("list_filter_null([", "[r for r in [").replace("end]) end as quality", "end] if r is not null] end as quality")
CHAIN = f"with {CASES.strip()}, {SERIES.strip()}"
FULL = f"{CHAIN}, {QUALITY.strip()}"


def measured(spark, sf_dir):
    """Full series with densities and, from the row's number, stand-ins for what the image job measures."""
    n = F.col("row_ord")
    rows = op.with_density(op.full_series(load(spark, sf_dir, "catalog")), load(spark, sf_dir, "case_desc"))
    return rows.withColumns({
        "has_file": n % 23 != 0, "height": F.when(n % 41 != 0, F.col("height")), "mask_ratio": (n % 101) / 100, "mask_pixels": (n % 103) * 100,
        "bright_ratio": (n % 13) / 200, "dark_ratio": (n % 19) / 250, "skin_line": n % 11 != 0, "marker_score": n % 47,
    })


def checked(spark, sf_dir):
    return op.with_status(op.quality_checked(measured(spark, sf_dir)))


@query("scan_case_tables", "select trim(patient_id) as patient_id, trim(side) as side, trim(view_raw) as view_raw, nullif(trim(density_code), '') as density_code, file_ord, row_ord from case_desc", "case_desc")
def scan_case_tables(spark, sf_dir):
    paths = readers.write_case_files(load(spark, sf_dir, "case_desc"), scratch_path(spark, "cases"))
    return readers.case_tables(spark, paths).select("patient_id", "side", "view_raw", "density_code", "file_ord", "row_ord")


@query("union_case_tables", "select file_ord, count(*) as n, count(nullif(trim(density_code), '')) as with_density from case_desc group by file_ord", "case_desc")
def union_case_tables(spark, sf_dir):
    paths = readers.write_case_files(load(spark, sf_dir, "case_desc"), scratch_path(spark, "cases"))
    return readers.case_tables(spark, paths).groupBy("file_ord").agg(F.count("*").alias("n"), F.count("density_code").alias("with_density"))


@query("scan_series_catalogue", "select row_ord, modality, trim(series_description) as series_description, series_id, image_path from catalog", "catalog")
def scan_series_catalogue(spark, sf_dir):
    path = scratch_path(spark, "series")
    load(spark, sf_dir, "catalog").select("modality", "series_description", "series_id", "image_path", "row_ord").write.csv(path, header=True)
    return readers.series_catalogue(spark, path).withColumn("series_description", F.trim("series_description"))


@query("filter_full_series", f"{CHAIN} select row_ord, patient_id, laterality, view from series", "catalog case_desc")
def filter_full_series(spark, sf_dir):
    return op.full_series(load(spark, sf_dir, "catalog")).select("row_ord", "patient_id", "laterality", "view")


@query("map_density_code", "select row_ord, case trim(density_code) when '1' then 'fatty' when '2' then 'scattered' when '3' then 'heterogeneous' when '4' then 'dense' end as density from case_desc", "case_desc")
def map_density_code(spark, sf_dir):
    return load(spark, sf_dir, "case_desc").select("row_ord", op.density_name(F.col("density_code")).alias("density"))


@query("density_lookup_join", f"{CHAIN} select row_ord, patient_id, laterality, view, density from series left join lookup using (patient_id, laterality, view)", "catalog case_desc")
def density_lookup_join(spark, sf_dir):
    return op.with_density(op.full_series(load(spark, sf_dir, "catalog")), load(spark, sf_dir, "case_desc")).select("row_ord", "patient_id", "laterality", "view", "density")


@query(
    "rewrite_path",
    r"""with paths as (select image_path as path from catalog union all select url from urls)
select path, case when strpos(path, 'CBIS-DDSM/jpeg/') > 0 then substr(path, strpos(path, 'CBIS-DDSM/jpeg/') + 15) else regexp_extract(path, '[^/]*$') end as relative,
 regexp_replace(case when strpos(path, '/jpeg/') > 0 then regexp_extract(path, '.*/jpeg/(.*)$', 1) else regexp_extract(path, '(?:[^/]*/)?[^/]*$') end, '\.(?:jpg|JPG)', '.png', 'g') as mask from paths""",
    "catalog urls",
)
def rewrite_path(spark, sf_dir):
    paths = load(spark, sf_dir, "catalog").select(F.col("image_path").alias("path")).union(load(spark, sf_dir, "urls").select("url"))
    return paths.select("path", op.relative_path(F.col("path")).alias("relative"), op.mask_path(F.col("path")).alias("mask"))


@query("quality_rules", f"{FULL} select row_ord, array_to_string(quality, '|') as reason, len(quality) = 0 as ok, case when mask_pixels < 1000 then 1.0::double else bright0 end as bright_ratio from ruled", "catalog case_desc")
def quality_rules(spark, sf_dir):
    return op.quality_checked(measured(spark, sf_dir)).select("row_ord", F.array_join("reasons", "|").alias("reason"), "ok", "bright_ratio")


@query("reject_precedence", f"{FULL} select row_ord, array_to_string(reasons, '|') as reason from checked where len(reasons) > 0", "catalog case_desc")
def reject_precedence(spark, sf_dir):
    return checked(spark, sf_dir).filter(F.size("reasons") > 0).select("row_ord", F.array_join("reasons", "|").alias("reason"))


@query("reason_counters", f"{FULL}, named as (select unnest(case when len(reasons) = 0 then ['kept'] else [case when r like 'missing!_%' escape '!' then r else 'reject_' || r end for r in reasons] end) as counter from checked) select counter, count(*) as n from named group by counter", "catalog case_desc")
def reason_counters(spark, sf_dir):
    return op.reason_counters(checked(spark, sf_dir))


@query(
    "strata_counts",
    f"""{FULL}, strata as (select view, density, count(*) as n from checked where len(reasons) = 0 group by 1, 2)
select cast(sum(n) as bigint) as kept, min(n) as min_stratum, max(n) as max_stratum, round(max(n) / greatest(1.0, min(n)), 4) as imbalance_ratio, (max(n) - min(n)) / max(n) > 0.2 as warn_unbalanced, sum(n) < 2000 as warn_few from strata""",
    "catalog case_desc",
)
def strata_counts(spark, sf_dir):
    return op.strata_summary(op.strata_counts(checked(spark, sf_dir).filter(F.size("reasons") == 0)))


@query("strata_table", f"{FULL} select view, density, count(*) as n from checked where len(reasons) = 0 group by 1, 2", "catalog case_desc")
def strata_table(spark, sf_dir):
    return op.strata_counts(checked(spark, sf_dir).filter(F.size("reasons") == 0))


@query("sink_clean_split", f"{FULL} select case when len(reasons) = 0 then 'kept' else 'rejected' end as side, case when len(reasons) = 0 then view end as view, case when len(reasons) = 0 then density end as density, count(*) as n from checked group by 1, 2, 3", "catalog case_desc")
def sink_clean_split(spark, sf_dir):
    """Both outputs from one write, laid out by view and density."""
    kept, rejected, _ = readers.write_split(checked(spark, sf_dir), scratch_path(spark, "clean"))
    kept = spark.read.parquet(kept).groupBy(F.lit("kept").alias("side"), "view", "density")
    rejected = spark.read.parquet(rejected).groupBy(F.lit("rejected").alias("side"), F.lit(None).cast("string").alias("view"), F.lit(None).cast("string").alias("density"))
    return kept.agg(F.count("*").alias("n")).union(rejected.agg(F.count("*").alias("n")))


@query("split_counters", f"{FULL}, named as (select unnest(case when len(reasons) = 0 then ['kept'] else [case when r like 'missing!_%' escape '!' then r else 'reject_' || r end for r in reasons] end) as counter from checked) select counter, count(*) as n from named group by counter", "catalog case_desc")
def split_counters(spark, sf_dir):
    """The counters that the write of both outputs filled on its way."""
    _, _, counters = readers.write_split(checked(spark, sf_dir), scratch_path(spark, "clean"))
    return spark.createDataFrame(sorted(counters.items()), "counter string, n long")


FILES = "files as (select distinct o_orderkey as row_ord from orders where o_orderkey % 3 <> 0), masks as (select distinct l_orderkey as row_ord from lineitem where l_quantity > 40)"


def listing(spark, sf_dir):
    """Stand-ins for the listings of images and masks."""
    files = load(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("row_ord")).distinct()
    masks = load(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("row_ord")).distinct()
    return files, masks


@query("source_file_semi", f"with {FILES} select row_ord, image_path from catalog where row_ord in (select row_ord from files)", "catalog")
def source_file_semi(spark, sf_dir):
    files, _ = listing(spark, sf_dir)
    return load(spark, sf_dir, "catalog").join(files, "row_ord", "left_semi").select("row_ord", "image_path")


@query(
    "source_mask_join",
    f"""with {FILES} select 'matched' as outcome, count(*) as n from catalog join files using (row_ord) join masks using (row_ord)
union all select 'skipped', count(*) from catalog where row_ord not in (select row_ord from files) or row_ord not in (select row_ord from masks)""",
    "catalog",
)
def source_mask_join(spark, sf_dir):
    files, masks = listing(spark, sf_dir)
    found = files.join(masks, "row_ord")
    rows = load(spark, sf_dir, "catalog").select("row_ord").join(found.select("row_ord", F.lit(True).alias("hit")), "row_ord", "left")
    counts = rows.agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("skipped"))
    return counts.selectExpr("stack(2, 'matched', matched, 'skipped', skipped) as (outcome, n)")


def catalogue_buckets(catalog):
    return buckets_for(catalog.count())


@query(
    "bucketed_files_masks",
    f"with {FILES} select row_ord, row_ord in (select row_ord from files) as has_file, row_ord in (select row_ord from masks) as has_mask from catalog",
    "catalog",
)
def bucketed_files_masks(spark, sf_dir):
    """The catalogue against both listings, all three in buckets of the row's number: no exchange under either join."""
    catalog = load(spark, sf_dir, "catalog").select("row_ord")
    n = catalogue_buckets(catalog)
    files, masks = (bucketed(rows.withColumn(hit, F.lit(True)), hit, ["row_ord"], n, unique=True) for rows, hit in zip(listing(spark, sf_dir), ("has_file", "has_mask")))
    rows = joined(bucketed(catalog, "catalog", ["row_ord"], n), [files, masks])
    return rows.select("row_ord", F.coalesce("has_file", F.lit(False)).alias("has_file"), F.coalesce("has_mask", F.lit(False)).alias("has_mask"))


@query("bucketed_density", f"{CHAIN} select density, view, count(*) as n, min(row_ord) as first_row from series left join lookup using (patient_id, laterality, view) group by 1, 2", "catalog case_desc")
def bucketed_density(spark, sf_dir):
    """Rows per density and view by a join of buckets of patient, side and view."""
    series = op.full_series(load(spark, sf_dir, "catalog")).select("row_ord", "patient_id", "laterality", "view")
    keys, n = ["patient_id", "laterality", "view"], catalogue_buckets(series)
    rows = joined(bucketed(series, "series", keys, n), [bucketed(op.density_lookup(load(spark, sf_dir, "case_desc")), "lookup", keys, n, unique=True)])
    return rows.groupBy("density", "view").agg(F.count("*").alias("n"), F.min("row_ord").alias("first_row"))


NAMES = r"""names as (select url as key, page_id, regexp_extract(url, '[^/]*$') as name, regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\.[^.]*$', '\1') as stem from urls),
metas as (select concat(cast(page_id as varchar), '.html') as file_name, page_id % 7 as info from urls where page_id % 3 = 0 union all select regexp_extract(url, '[^/]*$'), page_id % 5 from urls where page_id % 4 = 0),
by_name as (select file_name as key, max(info) as info from metas group by 1),
by_stem as (select regexp_replace(file_name, '^(.+)\.[^.]*$', '\1') as key, max(info) as info from metas group by 1)"""


@query("meta_by_name_or_stem", f"with {NAMES} select n.page_id, coalesce(a.info, b.info, -1) as info from names n left join by_name a on n.name = a.key left join by_stem b on n.stem = b.key", "urls")
def meta_by_name_or_stem(spark, sf_dir):
    """Full name first, then the stem, else -1."""
    urls = load(spark, sf_dir, "urls")
    names = urls.select("page_id", op.base_name(F.col("url")).alias("name"), op.stem(F.col("url")).alias("stem"))
    metas = urls.filter("page_id % 3 = 0").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"), (F.col("page_id") % 7).alias("info"))
    metas = metas.union(urls.filter("page_id % 4 = 0").select(op.base_name(F.col("url")), F.col("page_id") % 5))
    by_name = metas.groupBy(F.col("file_name").alias("name")).agg(F.max("info").alias("by_name"))
    by_stem = metas.groupBy(op.stem(F.col("file_name")).alias("stem")).agg(F.max("info").alias("by_stem"))
    return names.join(by_name, "name", "left").join(by_stem, "stem", "left").select("page_id", F.coalesce("by_name", "by_stem", F.lit(-1)).alias("info"))


@query("paired_source_first", "with u as (select page_id, url, regexp_extract(url, '[^/]*$') as name from urls), first as (select name, min(url) as source from u group by name) select page_id, source from u left join first using (name)", "urls")
def paired_source_first(spark, sf_dir):
    u = load(spark, sf_dir, "urls").withColumn("name", op.base_name(F.col("url")))
    return u.join(u.groupBy("name").agg(F.min("url").alias("source")), "name", "left").select("page_id", "source")


@query("filter_view_density", "select row_ord from captions where upper(view_key) = 'SRC1' and lower(density_key) = 'en'", "captions")
def filter_view_density(spark, sf_dir):
    return readers.filter_view_density(load(spark, sf_dir, "captions"), "view_key", "density_key", "src1", "EN", {"en": 1, "de": 2, "fr": 3, "es": 4}).select("row_ord")


@query("filter_aspect", "select row_ord from catalog where greatest(height, width) / greatest(least(height, width), 1) <= 2.2", "catalog")
def filter_aspect(spark, sf_dir):
    return readers.filter_aspect(load(spark, sf_dir, "catalog")).select("row_ord")


@query("min_side_filter", "select row_ord from catalog where least(height, width) >= 256", "catalog")
def min_side_filter(spark, sf_dir):
    return load(spark, sf_dir, "catalog").filter(F.least("height", "width") >= 256).select("row_ord")


@query("scan_clean_metadata", "select row_ord, file_name, view_key as view, density_key as density, n_chars as height from captions", "captions")
def scan_clean_metadata(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    load(spark, sf_dir, "captions").select("row_ord", "file_name", F.col("view_key").alias("view"), F.col("density_key").alias("density"), F.col("n_chars").alias("height")).write.csv(path, header=True)
    schema = T.StructType().add("row_ord", "long").add("file_name", "string").add("view", "string").add("density", "string").add("height", "long")
    return readers.clean_metadata(spark, path, schema, need=("file_name", "view", "density"))


@query("scan_rejects", "select row_ord, file_name, 'overexposed' as reason from captions where row_ord % 3 = 0", "captions")
def scan_rejects(spark, sf_dir):
    path = scratch_path(spark, "rejects")
    load(spark, sf_dir, "captions").select("row_ord", F.when(F.col("row_ord") % 3 == 0, F.col("file_name")).alias("file_name"), F.lit("overexposed").alias("reason")).write.json(path)
    return readers.rejects(spark, path).select("row_ord", "file_name", "reason")


@query("scan_jsonl_lenient", "select concat('k', cast(event_id as varchar)) as key, score from history where event_id % 5 <> 0", "history")
def scan_jsonl_lenient(spark, sf_dir):
    """The key stands under one of three names; every fifth line is blank or broken."""
    path = scratch_path(spark, "meta")
    key = F.concat(F.lit("k"), F.col("event_id").cast("string"))
    record = lambda name: F.to_json(F.struct(key.alias(name), "score"))
    line = F.when(F.col("event_id") % 10 == 0, F.lit("")).when(F.col("event_id") % 10 == 5, F.concat(F.lit("{"), key)).when(F.col("event_id") % 3 == 0, record("file_name")).when(F.col("event_id") % 3 == 1, record("filename")).otherwise(record("image"))
    load(spark, sf_dir, "history").select(line.alias("value")).write.text(path)
    return readers.lenient_jsonl(spark, path)


@query("scan_source_map", "select cast(event_id as varchar) as generated, line as source from history", "history")
def scan_source_map(spark, sf_dir):
    """JSON objects of up to 64 entries, generated name to source."""
    entry = F.struct(F.col("event_id").cast("string").alias("key"), F.col("line").alias("value"))
    batches = load(spark, sf_dir, "history").groupBy(F.floor(F.col("event_id") / 64)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return readers.source_map(batches.select("json"), "json")


@query("gen_source_pairs", "select cast(h.event_id as varchar) as generated, coalesce(m.line, cast(h.event_id as varchar)) as source from history h left join (select event_id, line from history where event_id % 4 > 0) m using (event_id)", "history")
def gen_source_pairs(spark, sf_dir):
    h = load(spark, sf_dir, "history")
    pairs = h.filter("event_id % 4 > 0").select(F.col("event_id").cast("string").alias("generated"), F.col("line").alias("source"))
    return h.select(F.col("event_id").cast("string").alias("generated")).join(pairs, "generated", "left").select("generated", F.coalesce("source", "generated").alias("source"))
