"""The registered queries of the operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddup, filteraudit, hnsw, langid, linededup, mixing, pagetext, periodic, pii, simhash, tokenfile, topk_search
from .common import table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
MIN_SITES = 5


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.exact_topk(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows


def op3_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), with_ids=False)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_spread_lines(table(spark, sf_dir, "documents"), MIN_SITES).select("doc_id", "n_lines", "n_dropped", "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    rows = docs.select("doc_id", "text", F.coalesce(langid.remainder() == 2, F.lit(False)).alias("held_out"))
    return langid.predict(rows, model, "doc_id", "held_out")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extracted(table(spark, sf_dir, "pages"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), planted=True, with_runs=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_mix_sources, op3_hnsw_search, op4_personal_data, op5_byte_bpe, op6_simhash_dedup, op7_line_dedup, op8_language_id, op9_token_files, op10_page_text, op11_embedding_dedup, op12_periodic_runs, op13_filter_audit)}

ORACLE_SQL = {
    "op1_exact_topk": """
with v as (
  select distinct vec_id, [floor(1024 * cast(x as double)) for x in embedding] as vec from embeddings
  where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.vec, c.vec) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op2_mix_sources": r"""
with rows as (
  select doc_id, source, md5(concat('mix:', coalesce(cast(doc_id as varchar), ''), ':', md5(coalesce(text, '')))) as key,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from rows group by source),
ranked as (
  select source, source_size, cast(list_extract([3, 1, 2], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)) as double) as weight,
    source_size * 2.0::double as cap from sizes),
ratios as (select *, cap / weight as ratio, sum(source_size) over () * 1.5::double as total from ranked),
levels as (
  select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from ratios),
final as (select *, max(case when level <= ratio then level end) over () as final from levels),
targets as (select source, source_size, case when final is null or ratio <= final then cap else final * weight end as target from final),
plan as (
  select *, case when source_size > 0 then cast(floor(floor(target) / source_size) as bigint) else 0 end as epochs from targets),
placed as (
  select r.doc_id, r.source, r.size, p.source_size, p.target, p.epochs, cast(floor(p.target) as bigint) - p.epochs * p.source_size as rest,
    sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows between unbounded preceding and current row) - r.size as before
  from rows r join plan p on r.source is not distinct from p.source)
select doc_id, source, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken from placed""",
    "op7_line_dedup": """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
spread as (
  select trim(line, ' ' || chr(13)) as line, arg_min(struct_pack(d := doc_id, p := pos), struct_pack(n := doc_id is null, d := doc_id, p := pos)) as first
  from lines where trim(line, ' ' || chr(13)) <> '' group by 1 having count(distinct coalesce(source, chr(1) || 'none')) >= 5),
marked as (
  select l.doc_id, l.pos, l.line, s.line is not null and (l.doc_id, l.pos) is distinct from (s.first.d, s.first.p) as gone
  from lines l left join spread s on trim(l.line, ' ' || chr(13)) = s.line)
select doc_id, cast(count(*) filter (where trim(line, ' ' || chr(13)) <> '') as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text from marked group by doc_id""",
    "op13_filter_audit": r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
marks as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
flagged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    cast(len(words) < 200 as int) + 2 * cast(100 * len(list_distinct(words)) < 50 * len(words) as int)
    + 4 * cast(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) as int)
    + 8 * cast(regexp_matches(text, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by text), false) as int) as failed
  from docs left join marks using (doc_id)),
letters as (select unnest([0, 1, 2, 3, 4]) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (
  select array_to_string([substr('ABCDE', x + 1, 1) for x in o], '') as filter_order, cast(s as int) as step, cast(1 << o[s] as int) as bit,
    cast(coalesce(list_sum([1 << x for x in o[:s - 1]]), 0) as int) as before from orders, unnest([1, 2, 3, 4, 5]) as t(s)),
counts as (select part, failed, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from flagged group by 1, 2)
select part, filter_order, step,
  cast(coalesce(sum(n) filter (where failed & (before | bit) = 0), 0) as bigint) as kept,
  cast(coalesce(sum(n) filter (where failed & bit > 0 and failed & before = 0), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (where failed & bit > 0 and failed & before > 0), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (where failed = bit), 0) as bigint) as unique_fails,
  cast(coalesce(sum(good) filter (where failed & bit > 0 and failed & before = 0), 0) as bigint) as good_lost,
  cast(coalesce(sum(toxic) filter (where failed & bit > 0 and failed & before = 0), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(n * (120 // nullif(bit_count(failed), 0))) filter (where failed & bit > 0), 0) as bigint) as shapley
from counts cross join steps group by part, filter_order, step""",
}
