"""Summaries of batches, rankings, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import artifact_burden, source_quality_score
from ..sources.scratch import stored

REPORT_SCHEMA = "item string, ok string, tier string, total_score string, modality_p string, funnel_veto string, soft_reasons string, tags string"


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def batch_summary(rows: DataFrame) -> DataFrame:
    """One row per run_name. The share of ok rows is that of two counts, and a veto is known without an array if there is has_veto."""
    veto = F.col("has_veto") if "has_veto" in rows.columns else F.size("group_veto") > 0
    return rows.groupBy("run_name").agg(
        F.count("*").alias("count"),
        F.count_if("ok").alias("ok_count"),
        F.round(F.count_if("ok") / F.count("*"), 6).alias("pass_rate"),
        F.round(F.avg("total_score"), 4).alias("mean_total_score"),
        F.round(F.avg("ps_slope"), 4).alias("mean_ps_slope"),
        F.coalesce(F.round(F.avg(F.when(F.col("brisque") >= 0, F.col("brisque"))), 4), F.lit(-1.0)).alias("mean_brisque"),
        F.count_if(veto).alias("veto_count"),
        *[F.round(F.avg(f"group_{g}"), 6).alias(f"group_{g}") for g in "ABCDEF"],
    )


def violation_rates(rows: DataFrame) -> DataFrame:
    """run_name, tag, n, rate of the run's rows. One pass: each row counts once under a null tag, which makes the
    run's total."""
    marked = rows.select("run_name", F.explode(F.concat(F.array(F.lit(None).cast("string")), "tags")).alias("tag"))
    counts = marked.groupBy("run_name", "tag").agg(F.count("*").alias("n"))  # a row per run and tag
    total = F.max(F.when(F.col("tag").isNull(), F.col("n"))).over(Window.partitionBy("run_name"))
    return counts.withColumn("total", total).filter("tag is not null").select("run_name", "tag", "n", F.round(F.col("n") / F.col("total"), 4).alias("rate"))


def metrics_by_tier(rows: DataFrame) -> DataFrame:
    quality = F.coalesce("quality_score", "total_score") if "quality_score" in rows.columns else F.col("total_score")
    return rows.groupBy("run_name").agg(
        F.count("*").alias("n"),
        F.round(share(F.col("tier") == 1), 6).alias("tier1_ratio"),
        F.round(F.avg("semantic_score"), 6).alias("mean_semantic"),
        F.round(F.avg(quality), 6).alias("mean_quality"),
        F.round(share(F.col("ok")), 6).alias("pass_rate"),
    )


def ranked(rows: DataFrame, by: list, *order: Column, k: int) -> DataFrame:
    """Rank within by; Catalyst turns the filter into a limit per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def top_ranked(rows: DataFrame, k: int) -> DataFrame:
    out = ranked(rows, ["run_name"], F.asc("tier"), F.desc("final_rank_score"), F.desc("total_score"), F.asc("item"), k=k)
    return out.select("run_name", "item", "tier", "final_rank_score", "total_score", "rank")


def preview(rows: DataFrame, k: int) -> DataFrame:
    out = ranked(rows, ["run_name"], F.desc("ok"), F.asc("tier"), F.desc("total_score"), F.asc("item"), k=k)
    return out.select("run_name", "item", "ok", "tier", "total_score", "rank")


def lesion_gate(rows: DataFrame, k: int) -> DataFrame:
    """Without masses, clusters or four dots and more; the first k of each run."""
    good = rows.filter(~((F.col("mass_count") > 0) | (F.col("cluster_count") > 0) | (F.col("calc_dots") >= 4)))
    return ranked(good, ["run_name"], F.asc("item"), k=k).select("run_name", "item", "rank")


def filter_shape(rows: DataFrame) -> DataFrame:
    """Drops bad areas, shapes and sides; what is not known is kept."""
    c = F.col
    bad = (c("area_frac") < 0.08) | (c("area_frac") > 0.85) | (c("circularity") < 0.30) | (c("convex_defect") > 0.45) | (c("aspect") > 2.2)
    return rows.filter(~F.coalesce(bad, F.lit(False)))


def pooled(rows: DataFrame) -> DataFrame:
    """item, score, priority: 0 clean, 1 likely to imprint artifacts."""
    return filter_shape(rows).select("item", F.round(source_quality_score(), 6).alias("score"), F.when(artifact_burden(), 1).otherwise(0).alias("priority"))


def source_pool(rows: DataFrame, n: int) -> DataFrame:
    """The n best, clean ones first."""
    return pooled(rows).orderBy("priority", F.desc("score"), "item").limit(n)


def with_fallback(rows: DataFrame, n: int) -> DataFrame:
    """All clean ones, and of the others as many as are missing up to n."""
    pool = stored(pooled(rows), "pool")
    clean = pool.filter("priority = 0")
    missing = max(0, n - clean.count())
    others = pool.filter("priority = 1").orderBy(F.desc("score"), "item").limit(missing)
    return clean.select("item", "priority").union(others.select("item", "priority"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hash order, the same however the rows are dealt."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def report(rows: DataFrame) -> DataFrame:
    """Columns in fixed order, nested ones as JSON, nothing null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tags = F.when(F.size("tags") > 0, F.array_join("tags", "|")).otherwise("pass")
    return rows.select("item", text("ok").alias("ok"), text("tier").alias("tier"), text("total_score").alias("total_score"), text("modality_p").alias("modality_p"), F.to_json("funnel_veto").alias("funnel_veto"), F.to_json("soft_reasons").alias("soft_reasons"), tags.alias("tags"))


# The order of tags in comparison tables where rates tie.
KNOWN_TAGS = ["AREA_BAD", "SHAPE_ODD", "BLOWOUT", "DEAD_DARK", "ARTIFACT_BUBBLES", "EDGE_VOIDS", "BANDING", "NO_PECTORAL", "LOW_CONTRAST", "OVEREXPOSED", "LOW_DR", "OVER_STRETCHED", "TEXTURE_UNNATURAL", "TOO_UNIFORM", "TOO_NOISY", "HIST_OFF_REAL", "DENSITY_MISMATCH", "AREA_BORDER", "read_failed"]
SUMMARY_SCHEMA = "count long, total_images long, ok_count long, pass_count long, pass_rate double, mean_total_score double, mean_brisque double, violation_rates map<string,double>, group_means map<string,double>, group_mean_scores map<string,double>"


def write_summaries(summary: DataFrame, rates: DataFrame, path: str) -> None:
    """One folder per run, named after it, with the run's summary as JSON."""
    maps = rates.groupBy("run_name").agg(F.map_from_entries(F.collect_list(F.struct("tag", "rate"))).alias("violation_rates"))
    groups = F.create_map(*[x for g in "ABCDEF" for x in (F.lit(g), F.col(f"group_{g}"))]).alias("group_means")
    rows = summary.join(maps, "run_name", "left").select("run_name", "count", "ok_count", "pass_rate", "mean_total_score", "mean_brisque", "violation_rates", groups)
    rows.withColumn("run", F.col("run_name")).drop("run_name").write.partitionBy("run").json(path)


def scan_summaries(spark, *paths: str) -> DataFrame:
    """Summaries found by a glob; the run is named by its folder; older names of fields are taken too. A file that is
    no JSON object of these fields is no run."""
    read = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_unreadable")
    rows = read.schema(f"{SUMMARY_SCHEMA}, _unreadable string").json([f"{p}/run=*/*" for p in paths]).filter("_unreadable is null")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)/[^/]*$", 1)
    groups = F.coalesce("group_means", "group_mean_scores")
    return rows.select(
        name.alias("run_name"),
        F.coalesce("count", "total_images", F.lit(0)).alias("total_images"),
        F.coalesce("ok_count", "pass_count", F.lit(0)).alias("pass_count"),
        F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"),
        F.coalesce("mean_total_score", F.lit(0.0)).alias("mean_total_score"),
        "mean_brisque",
        F.coalesce("violation_rates", F.create_map().cast("map<string,double>")).alias("violation_rates"),
        *[F.coalesce(F.try_element_at(groups, F.lit(g)), F.lit(0.0)).alias(f"group_{g}") for g in "ABCDEF"],
    )


def leaderboard(runs: DataFrame, by: str = "pass_rate", descending: bool = True) -> DataFrame:
    """Runs with their place. There are few rows to a run table, so one window over all is enough."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return runs.withColumn("place", F.row_number().over(Window.orderBy(order, "run_name")).cast("int"))


def tag_weights(rates: DataFrame) -> DataFrame:
    return rates.groupBy("tag").agg(F.round(F.sum("rate"), 4).alias("weight"))


def top_tags(rates: DataFrame, k: int) -> DataFrame:
    """The k heaviest tags; ties by the known order, then by name."""
    known = F.array_position(F.array(*map(F.lit, KNOWN_TAGS)), F.col("tag"))
    order = Window.orderBy(F.desc("weight"), F.when(known == 0, 999).otherwise(known - 1), "tag")
    return tag_weights(rates).withColumn("place", F.row_number().over(order).cast("int")).filter(F.col("place") <= k)


def percent(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", F.round(x * 100, places))


def top_violations(rates: DataFrame, k: int) -> DataFrame:
    """run_name and its k most frequent tags as text."""
    best = ranked(rates, ["run_name"], F.desc("rate"), F.asc("tag"), k=k)
    cells = F.array_sort(F.collect_list(F.struct("rank", F.concat("tag", F.lit("("), percent(F.col("rate"), 0), F.lit(")")).alias("cell"))))
    return best.groupBy("run_name").agg(F.array_join(F.transform(cells, lambda x: x["cell"]), " / ").alias("top"))


def ablation(runs: DataFrame, by: str, k: int = 30) -> DataFrame:
    """Best first by rate or score, smallest first by brisque, where missing counts as 9999."""
    order = F.asc("key") if by == "mean_brisque" else F.desc("key")
    return runs.withColumn("key", F.coalesce(F.col(by), F.lit(9999.0 if by == "mean_brisque" else 0.0))).orderBy(order, "run_name").limit(k)


def markdown(runs: DataFrame, tops: DataFrame) -> DataFrame:
    """A line of the comparison table per run."""
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    rows = runs.join(tops, "run_name", "left")
    cells = [F.col("run_name"), F.col("total_images").cast("string"), percent(F.col("pass_rate")), F.format_string("%.1f", F.round("mean_total_score", 1)), *[two(f"group_{g}") for g in "ABCDEF"], F.coalesce("top", F.lit("-"))]
    return rows.select("run_name", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


#: Fields of the run table, besides a rate per tag.
RUN_FIELDS = ["total_images", "pass_count", "pass_rate", "mean_total_score", *(f"group_{g}" for g in "ABCDEF")]


def run_table(runs: DataFrame, rates: DataFrame, tags: list) -> DataFrame:
    """A row per run: its fields and the rates of the given tags, 0 where it has none. tags: a few names."""
    wide = rates.groupBy("run_name").pivot("tag", tags).agg(F.round(F.max("rate"), 4))
    joined = runs.join(wide, "run_name", "left")
    return joined.select("run_name", *RUN_FIELDS, *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"rate_{t}") for t in tags])
