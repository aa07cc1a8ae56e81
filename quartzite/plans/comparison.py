"""Queries that compare runs, validate verdicts, and keep parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import params, runs, validation
from ..sources.adapters import load
from ..sources.scratch import scratch_path, stored
from ..streaming import verdicts
from .grading import B, REVIEWED, SUMMARY, review_table
from .registry import query

RATES = "sizes as (select run_name, count(*) as total from reviewed group by 1), tagged as (select run_name, unnest(tags) as tag from reviewed), rates as (select run_name, tag, round(count(*) / max(total), 4) as rate from tagged join sizes using (run_name) group by 1, 2)"
ALL = f"with {REVIEWED}, {SUMMARY}, {RATES}"


#: What summaries and rates read of a verdict: no names of items, no tiers.
SUMMARIZED = ("run_name", "ok", "total_score", "ps_slope", "brisque", "group_veto", "tags", *(f"group_{g}" for g in "ABCDEF"))


def summaries(spark, sf_dir):
    """(summary per run, rates per run and tag), settled: a few rows."""
    table = review_table(spark, sf_dir, *SUMMARIZED)
    return stored(runs.batch_summary(table), "summary"), stored(runs.violation_rates(table), "rates")


def scanned(spark, sf_dir):
    summary, rates = summaries(spark, sf_dir)
    path = scratch_path(spark, "runs")
    runs.write_summaries(summary, rates, path)
    return runs.scan_summaries(spark, path), rates


GROUPS = ", ".join(f"group_{g}" for g in "ABCDEF")


@query("scan_run_summaries", f"{ALL} select run_name, count as total_images, ok_count as pass_count, pass_rate, mean_total_score, {GROUPS} from summary", B)
def scan_run_summaries(spark, sf_dir):
    return scanned(spark, sf_dir)[0].drop("mean_brisque", "violation_rates")


@query("tag_weight_across_runs", f"{ALL} select tag, round(sum(rate), 4) as weight from rates group by tag", B)
def tag_weight_across_runs(spark, sf_dir):
    return runs.tag_weights(scanned(spark, sf_dir)[0].select("run_name", F.explode("violation_rates").alias("tag", "rate")))


KNOWN = "[" + ", ".join(f"'{t}'" for t in runs.KNOWN_TAGS) + "]"


@query("top_tags", f"{ALL}, w as (select tag, round(sum(rate), 4) as weight from rates group by tag), r as (select *, cast(row_number() over (order by weight desc, coalesce(list_position({KNOWN}, tag), 1000), tag) as int) as place from w) select * from r where place <= 6", B)
def top_tags(spark, sf_dir):
    return runs.top_tags(summaries(spark, sf_dir)[1], 6)


TOPS = "tops as (select run_name, string_agg(tag || '(' || printf('%.0f%%', round(rate * 100, 0)) || ')', ' / ' order by rk) as top from (select *, row_number() over (partition by run_name order by rate desc, tag) as rk from rates) where rk <= 4 group by run_name)"


@query("top_violations_per_run", f"{ALL}, {TOPS} select * from tops", B)
def top_violations_per_run(spark, sf_dir):
    return runs.top_violations(summaries(spark, sf_dir)[1], 4)


@query("leaderboard", f"{ALL} select run_name, pass_rate, mean_total_score, cast(row_number() over (order by pass_rate desc nulls last, run_name) as int) as place from summary", B)
def leaderboard(spark, sf_dir):
    return runs.leaderboard(scanned(spark, sf_dir)[0], "pass_rate").select("run_name", "pass_rate", "mean_total_score", "place")


@query("ablation_table", f"{ALL} select run_name, coalesce(mean_brisque, 9999) as key from summary order by 2, 1 limit 30", B)
def ablation_table(spark, sf_dir):
    return runs.ablation(summaries(spark, sf_dir)[0], "mean_brisque").select("run_name", "key")


TIERS = "tiers as (select run_name, avg(case when tier = 1 then 1.0 else 0 end) as tier1_ratio, avg(semantic_score) as mean_semantic from reviewed group by 1)"


@query("grid_objective", f"{ALL}, {TIERS} select run_name, round(round(tier1_ratio, 6) * round(mean_semantic, 6), 6) as objective from tiers order by 2 desc, 1 limit 1", B)
def grid_objective(spark, sf_dir):
    rows = runs.metrics_by_tier(review_table(spark, sf_dir))
    return rows.select("run_name", F.round(F.col("tier1_ratio") * F.col("mean_semantic"), 6).alias("objective")).orderBy(F.desc("objective"), "run_name").limit(1)


@query("checkpoint_select", f"{ALL}, {TIERS} select run_name, round(tier1_ratio, 6) as tier1_ratio, round(mean_semantic, 6) as mean_semantic, cast(row_number() over (order by round(tier1_ratio, 6) desc, round(mean_semantic, 6) desc, run_name) as int) as place from tiers", B)
def checkpoint_select(spark, sf_dir):
    from pyspark.sql import Window

    rows = runs.metrics_by_tier(review_table(spark, sf_dir)).select("run_name", "tier1_ratio", "mean_semantic")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("tier1_ratio"), F.desc("mean_semantic"), "run_name")).cast("int"))


@query("percent_format", "select item, printf('%.1f%%', round(l_discount_text * 100, 1)) as cell from (select item, bright_ratio as l_discount_text from item_metrics)", B)
def percent_format(spark, sf_dir):
    return load(spark, sf_dir, B).select("item", runs.percent(F.col("bright_ratio")).alias("cell"))


@query("sink_run_table", f"{ALL}, {TOPS} select run_name, '| ' || concat_ws(' | ', run_name, cast(count as varchar), printf('%.1f%%', round(pass_rate * 100, 1)), printf('%.1f', round(mean_total_score, 1)), " + ", ".join(f"printf('%.2f', round(group_{g}, 2))" for g in "ABCDEF") + ", coalesce(top, '-')) || ' |' as line from summary left join tops using (run_name)", B)
def sink_run_table(spark, sf_dir):
    table, rates = scanned(spark, sf_dir)
    path = scratch_path(spark, "markdown")
    runs.markdown(table, runs.top_violations(rates, 4)).write.csv(path, header=True)
    return spark.read.csv(path, schema="run_name string, line string", header=True)


FIELDS = " union all ".join(f"select run_name, '{f}' as field, cast({'count' if f == 'total_images' else 'ok_count' if f == 'pass_count' else f} as double) as value from summary" for f in runs.RUN_FIELDS)


@query("sink_run_csv", f"{ALL}, w as (select tag, round(sum(rate), 4) as weight from rates group by tag), f as (select tag from w order by weight desc, coalesce(list_position({KNOWN}, tag), 1000), tag limit 6) {FIELDS} union all select summary.run_name, 'rate_' || f.tag, coalesce(rate, 0) from summary cross join f left join rates on rates.run_name = summary.run_name and rates.tag = f.tag", B)
def sink_run_csv(spark, sf_dir):
    """The run table as CSV with a column per frequent tag, read again, a row per run and field."""
    table, rates = scanned(spark, sf_dir)
    tags = [r["tag"] for r in runs.top_tags(rates, 6).orderBy("place").collect()]  # six names
    path = scratch_path(spark, "run-table")
    wide = runs.run_table(table, rates, tags)
    wide.write.csv(path, header=True)
    back = spark.read.csv(path, schema=wide.schema, header=True)
    return back.select("run_name", F.explode(F.create_map(*[x for c in wide.columns[1:] for x in (F.lit(c), F.col(f"`{c}`").cast("double"))])).alias("field", "value"))


@query("scan_runs_with_unreadable", f"{ALL} select run_name, count as total_images from summary", B)
def scan_runs_with_unreadable(spark, sf_dir):
    """Two files that are no summaries lie among the runs; they are no runs."""
    summary, rates = summaries(spark, sf_dir)
    path = scratch_path(spark, "runs")
    runs.write_summaries(summary, rates, path)
    broken = spark.createDataFrame([("broken", '{"count": 5, "pass_'), ("text", "not json at all")], "run string, value string")
    broken.write.partitionBy("run").mode("append").format("text").save(f"{path}-broken")
    return runs.scan_summaries(spark, path, f"{path}-broken").select("run_name", "total_images")


T = "truth"
LABEL = "j as (select *, case when lower(image) like 'good!_%' escape '!' then 'good' when lower(image) like 'bad!_%' escape '!' then 'bad' end as label, not ok or tier >= 2 as stopped, case when not image like 'bad!_%' escape '!' then '' else split_part(substr(image, 5), '_', 1) end as category from truth)"


@query("file_truth_label", f"with {LABEL} select doc_id, label, category from j", T)
def file_truth_label(spark, sf_dir):
    return load(spark, sf_dir, T).select("doc_id", validation.truth_label(F.col("image")).alias("label"), validation.bad_category(F.col("image")).alias("category"))


@query(
    "validation_metrics",
    f"""with {LABEL}, c as (select count(*) filter (where label = 'good') as n_good, count(*) filter (where label = 'bad') as n_bad, count(*) filter (where label is null) as n_unlabeled, count(*) filter (where label = 'bad' and stopped) as bad_hits, count(*) filter (where label = 'bad' and not stopped) as bad_misses, count(*) filter (where label = 'good' and stopped) as false_kills from j)
select *, coalesce(round(bad_hits / nullif(n_bad, 0), 6), 0) as veto_recall, coalesce(round(false_kills / nullif(n_good, 0), 6), 0) as false_kill_rate from c""",
    T,
)
def validation_metrics(spark, sf_dir):
    return validation.metrics(load(spark, sf_dir, T))


@query("validation_misses", f"with {LABEL} select label, image from j where (label = 'bad' and not stopped) or (label = 'good' and stopped)", T)
def validation_misses(spark, sf_dir):
    return validation.misses(load(spark, sf_dir, T))


@query("validation_by_category", f"with {LABEL} select category, count(*) filter (where stopped) as hit, count(*) filter (where not stopped) as miss from j where label = 'bad' group by 1", T)
def validation_by_category(spark, sf_dir):
    return validation.by_category(load(spark, sf_dir, T))


@query("top5_purity", f"with {LABEL}, f as (select * from j where label is not null order by tier, final_rank_score desc, image limit 5) select coalesce(bool_and(label = 'good' and ok and tier = 1), false) and count(*) = 5 as pure, string_agg(image, ',' order by image) as images from f", T)
def top5_purity(spark, sf_dir):
    return validation.top_purity(load(spark, sf_dir, T))


PRESET = "p as (select doc_id, case when doc_id % 7 = 0 then 'n/a' else cast(1 + n_chars % 5 as varchar) end as anatomy, cast(1 + n_chars % 4 as varchar) as texture, cast(n_chars % 6 as varchar) as contrast, cast(1 + n_chars % 3 as varchar) as artifact, cast(n_chars % 5 as varchar) as overall from documents where doc_id % 4 > 0), e as (select d.doc_id, " + ", ".join(f"coalesce(try_cast({c} as double), 3) as {c}" for c in validation.EXPERT_WEIGHTS) + " from documents d left join p using (doc_id)), w as (select *, round(" + " + ".join(f"{c} * {v}::double" for c, v in validation.EXPERT_WEIGHTS.items()) + ", 2) as weighted_total from e)"


def presets(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    n = F.col("n_chars")
    given = docs.filter("doc_id % 4 > 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise((1 + n % 5).cast("string")).alias("anatomy"), *[x.cast("string").alias(c) for x, c in ((1 + n % 4, "texture"), (n % 6, "contrast"), (1 + n % 3, "artifact"), (n % 5, "overall"))])
    return validation.weighted(validation.with_presets(docs.select("doc_id"), given, "doc_id"))


@query("expert_preset_join", f"with {PRESET} select * from w")
def expert_preset_join(spark, sf_dir):
    return presets(spark, sf_dir)


@query("expert_summary", f"with {PRESET} select count(*) as n, round(avg(weighted_total), 2) as mean_total, " + ", ".join(f"round(avg({c}), 4) as {c}" for c in validation.EXPERT_WEIGHTS) + " from w")
def expert_summary(spark, sf_dir):
    return presets(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("weighted_total"), 2).alias("mean_total"), *[F.round(F.avg(c), 4).alias(c) for c in validation.EXPERT_WEIGHTS])


CACHE = "pool as (select doc_id, sha256(source || ':' || doc_id || ':' || n_chars) as signature from documents), cache as (select signature, doc_id % 2 = 0 as passed from pool where doc_id % 5 > 0)"


def pool_and_cache(spark, sf_dir):
    pool = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")), 256).alias("signature"))
    return pool, pool.filter("doc_id % 5 > 0").select("signature", (F.col("doc_id") % 2 == 0).alias("passed"))


@query("verdict_cache_split", f"with {CACHE} select doc_id, coalesce(cast(passed as varchar), 'to_score') as verdict from pool left join cache using (signature)")
def verdict_cache_split(spark, sf_dir):
    known, todo = validation.split_by_cache(*pool_and_cache(spark, sf_dir), "signature")
    return known.select("doc_id", F.col("passed").cast("string").alias("verdict")).union(todo.select("doc_id", F.lit("to_score")))


@query("verdict_cache_stream", f"with {CACHE} select doc_id, coalesce(cast(passed as varchar), 'to_score') as verdict from pool left join cache using (signature)")
def verdict_cache_stream(spark, sf_dir):
    """The same answers from a stream: the cache is its first state, the pool arrives in two parts and the first comes again."""
    pool, cache = pool_and_cache(spark, sf_dir)
    seen = F.lit("2026-01-02 00:00:00").cast("timestamp")
    known = cache.select("signature", F.lit(None).cast("string").alias("item"), (seen - F.expr("interval 1 day")).alias("seen_at"), "passed")
    files = pool.select("signature", F.col("doc_id").cast("string").alias("item"), seen.alias("seen_at"), F.lit(None).cast("boolean").alias("passed"))
    base = scratch_path(spark, "verdicts")
    for part in ("pmod(hash(item), 2) = 0", "true"):
        files.filter(part).write.mode("append").parquet(f"{base}/in")
        verdicts.answered_files(spark, f"{base}/in", known, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(verdicts.ANSWERS).parquet(f"{base}/out").select(F.col("item").cast("long").alias("doc_id"), "verdict")


@query("unchecked_topup", f"with {CACHE}, k as (select doc_id, case when passed then 0 when passed is null then 1 end as priority from pool left join cache using (signature)) select doc_id, priority from k where priority is not null order by priority, doc_id limit 500")
def unchecked_topup(spark, sf_dir):
    known, todo = validation.split_by_cache(*pool_and_cache(spark, sf_dir), "signature")
    return validation.topped_up(known.filter("passed"), todo, "doc_id", 500)


REPLY = "case doc_id % 4 when 0 then 'Yes.' when 1 then 'no' when 2 then 'yes, no?' else source end"


@query("yes_no_verdict", f"with r as (select doc_id, upper({REPLY}) as t from documents) select doc_id, case when contains(t, 'YES') and not contains(t, 'NO') then true when contains(t, 'NO') and not contains(t, 'YES') then false end as verdict from r")
def yes_no_verdict(spark, sf_dir):
    return load(spark, sf_dir, "documents").selectExpr("doc_id", f"{REPLY} as t").select("doc_id", validation.yes_no(F.col("t")).alias("verdict"))


E = "history"
LAST = "r as (select *, row_number() over (partition by line order by recorded_at desc, event_id desc) as back from history), l as (select line, event_id, score, cast(row_number() over (partition by line order by recorded_at, event_id) as int) as index from r where back <= 5)"


TAGS = [f"TAG_{i}" for i in range(9)]
TOP6 = "array_to_string([x.t for x in list_sort([" + ", ".join(f"struct_pack(r := -(event_id * {i + 3} % 17) / 16.0::double, t := '{t}')" for i, t in enumerate(TAGS)) + "])[1:6]], '|')"


@query("history_last_n", f"with {LAST} select line, event_id, index, round(coalesce(score, 0), 2) as score, {TOP6} as top6 from l", E)
def history_last_n(spark, sf_dir):
    """The latest entries with their six most frequent violations, whose rates are made from the entry's number."""
    rates = F.create_map(*[x for i, t in enumerate(TAGS) for x in (F.lit(t), F.col("event_id") * (i + 3) % 17 / 16.0)])
    rows = params.latest(load(spark, sf_dir, E).withColumn("violation_rates", rates), ["line"], "recorded_at", "event_id", 5)
    top = F.transform(params.top_rates(F.col("violation_rates"), 6), lambda x: x["tag"])
    return rows.select("line", "event_id", "index", F.round(F.coalesce("score", F.lit(0)), 2).alias("score"), F.array_join(top, "|").alias("top6"))


@query("latest_runs", "select line, max(recorded_at) as last_at, count(*) as n from history group by line order by last_at desc, line limit 20", E)
def latest_runs(spark, sf_dir):
    return load(spark, sf_dir, E).groupBy("line").agg(F.max("recorded_at").alias("last_at"), F.count("*").alias("n")).orderBy(F.desc("last_at"), "line").limit(20)


FENCED = "case event_id % 4 when 0 then concat('Try ```json ', parameters_json, ' ``` then ```', '{\"strength\": 0.4}', '```') when 1 then concat('so: ', parameters_json) when 2 then concat('```', parameters_json, '``` end') else 'nothing here' end"
PARSED = "p as (select event_id, try_cast(json_extract_string(parameters_json, '$.k') as double) as k from history)"


@query("parse_llm_json", f"with {PARSED} select event_id, case when event_id % 4 = 3 then null else k end as k, case when event_id % 4 = 0 then 0.4::double end as strength from p", E)
def parse_llm_json(spark, sf_dir):
    rows = load(spark, sf_dir, E).selectExpr("event_id", f"{FENCED} as reply").select("event_id", params.parsed_reply(F.col("reply")).alias("m"))
    value = lambda k: F.try_element_at("m", F.lit(k)).try_cast("double").alias(k)
    return rows.select("event_id", value("k"), value("strength"))


NESTED = """case event_id % 4 when 0 then concat('Try ```json {"given": ', parameters_json, ', "eval": {"mode": "strict", "levels": [1, ', event_id, ']}, "on": true}``` then ```{"on": ', case when event_id % 8 = 0 then 'false' else '"no"' end, '}```')
 when 1 then concat('so: {"given": {"k": "', regexp_extract(parameters_json, '[0-9]+', 0), '"}, "note": "n"}') when 2 then concat('```{"given": [', event_id, '], "on": null}``` end') else 'nothing here' end"""


def nested_replies(spark, sf_dir):
    return load(spark, sf_dir, E).selectExpr("event_id", f"{NESTED} as reply").select("event_id", params.typed_reply(F.col("reply")).alias("reply"))


@query(
    "typed_replies",
    """with r as (select event_id, event_id % 4 as c, try_cast(regexp_extract(parameters_json, '[0-9]+', 0) as bigint) as k from history)
select event_id, case when c < 2 then k end as given_k, case c when 0 then 'strict' end as mode, case c when 0 then event_id end as level, case c when 2 then event_id end as listed,
 case when c = 0 then case when event_id % 8 = 0 then 'truth' else 'text' end when c = 2 then 'null' end as on_kind from r""",
    E,
)
def typed_replies(spark, sf_dir):
    """Values inside groups and lists of replies, by their types; of two blocks the later wins."""
    m = F.col("reply")
    return nested_replies(spark, sf_dir).select(
        "event_id", params.typed(m, "given", "$.k", "bigint").alias("given_k"), params.typed(m, "eval", "$.mode", "string").alias("mode"), params.typed(m, "eval", "$.levels[1]", "bigint").alias("level"),
        params.typed(m, "given", "$[0]", "bigint").alias("listed"), params.kind_of(F.try_element_at(m, F.lit("on"))).alias("on_kind"),
    )


@query(
    "reply_fields",
    """with r as (select event_id, event_id % 4 as c from history), f as (select 'given' as key, case c when 2 then 'array' else 'object' end as kind from r where c < 3
 union all select 'eval', 'object' from r where c = 0 union all select 'note', 'text' from r where c = 1 union all select 'on', case when c = 2 then 'null' when event_id % 8 = 0 then 'truth' else 'text' end from r where c in (0, 2))
select key, kind, count(*) as n from f group by 1, 2""",
    E,
)
def reply_fields(spark, sf_dir):
    """Which keys replies have, known or not, and what they hold."""
    return params.reply_fields(nested_replies(spark, sf_dir))


@query("clamp_parameters", f"with {PARSED}, u as (select event_id, 'k' as key, k as value from p where k is not null union all select event_id, 'num_steps', event_id % 100 + 0.25 from p) select event_id, key, case key when 'k' then round(greatest(5.0, least(90.0, value)), 4) else greatest(15, least(60, floor(value))) end as value from u", E)
def clamp_parameters(spark, sf_dir):
    n = F.col("event_id")
    rows = load(spark, sf_dir, E).select(n, F.map_concat(F.from_json("parameters_json", "map<string,string>"), F.create_map(F.lit("num_steps"), (n % 100 + 0.25).cast("string"), F.lit("unknown"), F.lit("1"), F.lit("strength"), F.lit("much"))).alias("m"))
    return params.clamped(rows.select("event_id", F.explode("m").alias("key", "value"))).select("event_id", "key", F.col("value").cast("double").alias("value"))


NOTES = "repeat(concat('note ', event_id, ' '), event_id % 400)"


@query("clamp_notes", f"select event_id, left({NOTES}, 2000) as notes from history where event_id % 400 > 0", E)
def clamp_notes(spark, sf_dir):
    rows = load(spark, sf_dir, E).filter("event_id % 400 > 0").selectExpr("event_id", "'notes_zh' as key", f"{NOTES} as value")
    return params.texts(rows).select("event_id", F.col("value").alias("notes"))


SIDES = "t as (select event_id, 'gabor_alpha' as key, event_id % 10 / 10.0::double as value from history where event_id % 3 > 0 union all select event_id, 'strength', event_id % 7 / 8.0::double from history), v as (select event_id, 'gabor_alpha' as key, event_id % 20 / 10.0::double as value from history where event_id % 4 > 0 union all select event_id, 'strength', event_id % 5 / 4.0::double from history where event_id % 2 = 0)"


@query("merge_parameters", f"with {SIDES} select event_id, key, case when t.value is null then v.value when v.value is null then t.value when key = 'gabor_alpha' then round(greatest(0, least(1, v.value * 0.6::double + t.value * (1 - 0.6::double))), 4) else round((t.value + v.value) / 2, 4) end as value from t full join v using (event_id, key)", E)
def merge_parameters(spark, sf_dir):
    n = F.col("event_id")
    h = load(spark, sf_dir, E)
    one = lambda rows, key, value: rows.select(n, F.lit(key).alias("key"), value.alias("value"))
    text = one(h.filter(n % 3 > 0), "gabor_alpha", n % 10 / 10.0).union(one(h, "strength", n % 7 / 8.0))
    visual = one(h.filter(n % 4 > 0), "gabor_alpha", n % 20 / 10.0).union(one(h.filter(n % 2 == 0), "strength", n % 5 / 4.0))
    return params.merged(text, visual, ["event_id", "key"])


@query(
    "tuning_state",
    """with s as (select event_id, event_id % 2 = 0 as cal, case when event_id % 3 > 0 then event_id % 4 / 4.0::double end as strict, case when event_id % 5 > 0 then event_id % 2 / 2.0::double end as technical, event_id % 4 / 4.0::double as passed, case when event_id % 6 > 0 then parameters_json end as proposal, case when event_id % 4 > 0 then 'run' end as used from history)
select event_id, coalesce(proposal, used) as parameters, case when cal then 'calibrated' else 'strict' end as eval_mode, case when cal and strict is not null and strict <> passed then 'check_strict_rate' when strict = 0 then 'fix_strict_defects' when technical is not null and technical <> passed then 'use_technical_rate' else 'synced' end as note from s where coalesce(proposal, used) is not null""",
    E,
)
def tuning_state(spark, sf_dir):
    n = F.col("event_id")
    rows = load(spark, sf_dir, E).select(n, (n % 2 == 0).alias("cal"), F.when(n % 3 > 0, n % 4 / 4.0).alias("strict"), F.when(n % 5 > 0, n % 2 / 2.0).alias("technical"), (n % 4 / 4.0).alias("passed"), F.coalesce(F.when(n % 6 > 0, F.col("parameters_json")), F.when(n % 4 > 0, "run")).alias("parameters"))
    return rows.filter("parameters is not null").select("event_id", "parameters", F.when(F.col("cal"), "calibrated").otherwise("strict").alias("eval_mode"), params.tuning_note(F.col("cal"), F.col("strict"), F.col("technical"), F.col("passed")).alias("note"))
