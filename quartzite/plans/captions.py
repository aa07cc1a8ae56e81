"""Queries of captions and balanced sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions as op
from ..sources.adapters import load
from ..sources.scratch import scratch_path
from .registry import query

C = "captions"
MAPPED = "m as (select row_ord, file_name, laterality, case row_ord % 3 when 0 then 'mlo' when 1 then 'CC' else 'XX' end as view, case row_ord % 5 when 0 then 'fatty' when 1 then 'scattered' when 2 then 'heterogeneous' when 3 then 'dense' else 'none' end as density from captions)"


def mapped(spark, sf_dir):
    """The caption vocabularies, by the row's number."""
    n = F.col("row_ord")
    return load(spark, sf_dir, C).select("row_ord", "file_name", "laterality", F.when(n % 3 == 0, "mlo").when(n % 3 == 1, "CC").otherwise("XX").alias("view"), F.element_at(F.array(*map(F.lit, ["fatty", "scattered", "heterogeneous", "dense", "none"])), (n % 5 + 1).cast("int")).alias("density"))


def _case(column: str, values: dict, default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + f" else '{default}' end"


STRUCTURED = f"""concat_ws(', ', 'mammography', {_case('upper(view)', op.VIEW_TEXT, 'mammogram view')}, {_case('upper(laterality)', op.SIDE_TEXT, 'breast')}, {_case('density', op.DENSITY_TEXT, 'fibroglandular density')}, 'skin line',
 case when upper(view) = 'MLO' then 'pectoral muscle' else 'compressed breast tissue' end, '{', '.join(op.ANATOMY[1:] + op.TEXT_FREE + op.CLOSING)}')"""


@query("caption_structured", f"with {MAPPED} select file_name, {STRUCTURED} as text from m", C)
def caption_structured(spark, sf_dir):
    return mapped(spark, sf_dir).select("file_name", op.structured(F.col("view"), F.col("laterality"), F.col("density")).alias("text"))


@query("caption_fixed_view", f"with {MAPPED} select file_name, concat('mammography, mediolateral oblique view, ', {_case('upper(laterality)', op.SIDE_TEXT, 'breast')}, ', ', {_case('density', op.FIXED_DENSITY, 'breast tissue')}, ', skin line, pectoral muscle, {', '.join(op.ANATOMY[1:] + op.TEXT_FREE + op.CLOSING)}') as text from m", C)
def caption_fixed_view(spark, sf_dir):
    return mapped(spark, sf_dir).select("file_name", op.fixed_view(F.col("laterality"), F.col("density")).alias("text"))


FIND = "f as (select row_ord, case row_ord % 4 when 0 then 'L' when 1 then 'right' when 2 then 'RIGHT' else 'both' end as side, case row_ord % 5 when 0 then 'MLO_2' when 1 then 'cc' when 2 then 'LM' when 3 then 'ml' else 'none' end as view, substr('1234ABCDX', cast(row_ord % 9 + 1 as int), 1) as density, case row_ord % 3 when 0 then 'MALIGNANT' when 1 then 'Benign_without_callback' end as pathology, case row_ord % 7 when 0 then 'mass' when 1 then 'Calcification' when 2 then 'calc' end as abnormality from captions)"


@query(
    "caption_findings",
    f"""with {FIND} select row_ord, concat('a mammography X-ray image of the ', case upper(side) when 'L' then 'left' when 'RIGHT' then 'right' else 'bilateral' end, ' breast, ', {_case("split_part(upper(view), '_', 1)", op.FINDING_VIEW, 'mammogram')}, ' view, ', {_case('density', op.FINDING_DENSITY, 'fibroglandular density')}, ', ',
 case when pathology is null and abnormality is null then 'no significant abnormality' else concat_ws(', ', case when lower(pathology) like '%malignant%' then 'malignant lesion' when lower(pathology) like '%benign%' then 'benign finding' end, case when lower(abnormality) like '%mass%' then 'breast mass' when lower(abnormality) like '%calc%' then 'microcalcifications' end) end, ', grayscale medical imaging, diagnostic quality') as text from f""",
    C,
)
def caption_findings(spark, sf_dir):
    n = F.col("row_ord")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (n % m + 1).cast("int"))
    text = op.findings(pick(4, "L", "right", "RIGHT", "both"), pick(5, "MLO_2", "cc", "LM", "ml", "none"), pick(9, *"1234ABCDX"), pick(3, "MALIGNANT", "Benign_without_callback", None), pick(7, "mass", "Calcification", "calc", None, None, None, None))
    return load(spark, sf_dir, C).select("row_ord", text.alias("text"))


@query(
    "prompt_for_filter",
    f"""with {MAPPED} select row_ord, case when density = 'none' then concat('base ', row_ord) else concat('medical grayscale mammogram, ', concat_ws(' ', case upper(view) when 'MLO' then 'MLO view' when 'CC' then 'CC view' end, density || ' density', case when upper(view) = 'MLO' then '{op.PROMPT_ANATOMY}' end), ', fine ligament texture, FFDM, no text, no labels') end as prompt from m""",
    C,
)
def prompt_for_filter(spark, sf_dir):
    return mapped(spark, sf_dir).select("row_ord", op.prompt(F.col("view"), F.col("density"), F.concat(F.lit("base "), F.col("row_ord").cast("string"))).alias("prompt"))


@query("sink_caption_table", f"with {MAPPED} select file_name, {STRUCTURED} as text from m", C)
def sink_caption_table(spark, sf_dir):
    path = scratch_path(spark, "captions")
    caption_structured(spark, sf_dir).write.csv(path, header=True)
    return spark.read.csv(path, schema="file_name string, text string", header=True)


@query("union_pos_neg_captions", f"with {MAPPED} select file_name, {STRUCTURED} as text from m where row_ord % 3 > 0 union all select file_name, '{op.NEGATIVE_CAPTION}' from m where row_ord % 3 = 0", C)
def union_pos_neg_captions(spark, sf_dir):
    rows = mapped(spark, sf_dir)
    good = rows.filter("row_ord % 3 > 0").select("file_name", op.structured(F.col("view"), F.col("laterality"), F.col("density")).alias("text"))
    return good.unionByName(rows.filter("row_ord % 3 = 0").select("file_name", F.lit(op.NEGATIVE_CAPTION).alias("text")))


@query("training_pairs", "with t as (select file_name || ',' || 'a, b ' || row_ord as line from captions where row_ord % 2 = 0) select c.file_name, coalesce(substr(t.line, strpos(t.line, ',') + 1), 'medical image') as text from captions c left join t on substr(t.line, 1, strpos(t.line, ',') - 1) = c.file_name", C)
def training_pairs(spark, sf_dir):
    """Lines split at the first comma; images without one get the default caption."""
    rows = load(spark, sf_dir, C)
    lines = rows.filter("row_ord % 2 = 0").select(F.concat("file_name", F.lit(",a, b "), F.col("row_ord").cast("string")).alias("line"))
    table = lines.select(F.substring_index("line", ",", 1).alias("file_name"), F.substring("line", F.instr("line", ",") + 1, F.length("line")).alias("text"))
    return rows.select("file_name").join(table, "file_name", "left").select("file_name", F.coalesce("text", F.lit("medical image")).alias("text"))


@query(
    "balance_oversample",
    """with s as (select view_key, density_key, count(*) as n from captions group by 1, 2), t as (select *, max(n) over () as target from s),
extra as (select view_key, density_key, n, unnest(range(n + 1, target + 1)) as slot from t),
picked as (select view_key, density_key, slot, cast('0x' || substr(md5('2026|' || view_key || '|' || density_key || '|' || slot), 1, 8) as bigint) % n + 1 as k from extra),
placed as (select *, row_number() over (partition by view_key, density_key order by row_ord) as k from captions)
select row_ord, view_key, density_key, k as slot from placed union all select row_ord, view_key, density_key, slot from picked join placed using (view_key, density_key, k)""",
    C,
)
def balance_oversample(spark, sf_dir):
    return op.oversampled(load(spark, sf_dir, C).select("row_ord", "view_key", "density_key"), ["view_key", "density_key"], "row_ord")


@query(
    "bucket_to_target",
    """with p as (select row_ord, density_key, row_number() over (partition by density_key order by row_ord) as k, count(*) over (partition by density_key) as n from captions),
s as (select distinct density_key, n, unnest(range(0, 600)) as slot from p)
select row_ord, density_key, slot from s join p using (density_key, n) where k = slot % n + 1""",
    C,
)
def bucket_to_target(spark, sf_dir):
    return op.to_target(load(spark, sf_dir, C).select("row_ord", "density_key"), ["density_key"], "row_ord", 600)


@query("eval_for_batch", "with runs as (select distinct source || '_' || lang || '_eval' as run from documents), b as (select distinct source || '_' || lang as batch from documents) select batch, max(run) as run from b left join runs on contains(run, batch) group by batch")
def eval_for_batch(spark, sf_dir):
    """The last run, by name, whose name contains the batch's."""
    names = load(spark, sf_dir, "documents").select(F.concat_ws("_", "source", "lang").alias("batch")).distinct()
    runs = names.select(F.concat("batch", F.lit("_eval")).alias("run"))
    return op.last_containing(names, "batch", runs, "run")
