"""Views that give the driver's tables the shapes of the library's inputs.

Each is one SQL text that Spark and DuckDB both run, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "catalog": """
select o_orderkey as row_ord,
 case when o_orderkey % 17 = 0 then 'CT' else 'MG' end as modality,
 case when o_orderkey % 5 = 0 then 'ROI mask images' else ' Full Mammogram images ' end as series_description,
 concat(case when o_orderkey % 2 = 0 then 'Mass-Training_P_' else 'Calc-Test_P_' end, lpad(cast(o_custkey as varchar(20)), 5, '0'),
   case when o_orderkey % 4 < 2 then '_LEFT' else '_right' end, case when o_orderkey % 3 = 0 then '_CC' else '_MLO' end) as series_id,
 concat('CBIS-DDSM/jpeg/uid', cast(o_orderkey % 97 as varchar(20)), '/1-', cast(o_orderkey as varchar(20)), '.jpg') as image_path,
 cast(floor(o_totalprice / 100) as int) as height, cast(floor(o_totalprice / 170) as int) as width
from orders""",
    "case_desc": """
select c_custkey as row_ord, cast(c_nationkey % 4 as int) as file_ord,
 concat('P_', lpad(cast(c_custkey % 700 as varchar(20)), 5, '0')) as patient_id,
 case when c_custkey % 2 = 0 then 'left ' else 'RIGHT' end as side,
 case when c_custkey % 3 = 0 then 'CC' else 'mlo' end as view_raw,
 case when c_custkey % 6 = 5 then '' else cast(c_nationkey % 5 as varchar(20)) end as density_code
from customer""",
    "item_metrics": """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20))) as item,
 concat('review_output_', cast(l_suppkey % 8 as varchar(20))) as run_name, l_linestatus = 'O' as is_real,
 l_quantity / 50 as mask_ratio, l_discount * 8 as circularity, l_extendedprice / 105000 as mean_intensity,
 l_tax * 3 as std_intensity, (l_quantity / 50 + l_discount * 5) / 1.5 as dynamic_range,
 l_discount as bright_ratio, l_tax * 4 as dark_ratio, l_tax * 60 as local_entropy,
 l_tax / 4 as edge_density, l_discount * 3 as cavity_ratio, cast(l_partkey % 25 as int) as bright_spots,
 l_discount * 20 as hu_dist, l_quantity / 60 as mirror_sim, l_partkey % 3 > 0 as pectoral_found,
 l_discount * 5 as contour_concavity, 1 + l_tax * 5 as contour_perim_ratio,
 cast(l_partkey % 9 as int) as round_isolated, l_tax / 1.8 as round_density, cast(l_partkey % 260 as int) as edge_voids_px,
 1 - l_tax * 5 as banding_score, 1 - l_discount * 9 as vert_struct_score, 1 - l_discount * 8 as grid_pattern_score,
 l_tax * 5.5 as anatomy_chaos, l_quantity / 9 as ps_slope, case when l_partkey % 11 = 0 then -1 else l_quantity * 1.5 end as brisque,
 case when l_partkey % 13 = 0 then null else l_discount * 10 end as modality_p, l_returnflag as source_group
from lineitem""",
    "profiles": "select vec_id as item, label as stratum, vec_id % 2 = 0 as is_real, embedding from embeddings",
    "captions": """
select doc_id as row_ord, concat(source, '/', lang, '/', cast(doc_id as varchar(20)), '.jpg') as file_name, source as view_key, lang as density_key,
 case when doc_id % 2 = 0 then 'LEFT' else 'right' end as laterality, n_chars from documents""",
    "history": """
select event_id, ts as recorded_at, concat('line_', cast(user_id as varchar(20))) as line, event_type as source_tag, value as score, props as parameters_json from events""",
    "truth": """
select d.doc_id, case when l.doc_id is null then concat('raw_', cast(d.doc_id as varchar(20)), '.png') when l.quality = 1 then concat('good_', cast(d.doc_id as varchar(20)), '.png')
  else concat('bad_', case when l.toxic = 1 then 'toxic_' else 'plain_' end, cast(d.doc_id as varchar(20)), '.png') end as image,
 d.n_chars % 7 > 1 as ok, 1 + cast(d.n_chars % 3 as int) as tier, cast(d.n_chars % 1000 as double) / 1000 as final_rank_score
from documents d left join labels l on d.doc_id = l.doc_id""",
    "urls": "select page_id, url from pages",
    "components": """
select l_orderkey as image_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as comp_id,
 cast(l_quantity * 12 as int) as area, cast(l_partkey % 480 as int) as x, cast(l_suppkey * 37 % 480 as int) as y,
 cast(4 + l_partkey % 23 as int) as w, cast(4 + l_suppkey % 19 as int) as h
from lineitem""",
}
# Spark takes a float and an int as doubles, DuckDB as floats: Spark's text names the type, so that both round alike.
TILES = {
    "spark": """
select vec_id as image_id, cast(pos div 8 as int) as y, cast(pos % 8 as int) as x, cast(floor((v + float(1)) * float(127.5)) as int) as v
from embeddings lateral view posexplode(embedding) t as pos, v""",
    "duckdb": """
select vec_id as image_id, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x, cast(floor((v + 1) * 127.5) as int) as v
from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the driver's tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TILES["spark"] if name == "tiles" else VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def cte(*names: str) -> str:
    """The views as a list of common table expressions for an oracle."""
    return ", ".join(f"{n} as ({TILES['duckdb'] if n == 'tiles' else VIEWS[n]})" for n in names)
