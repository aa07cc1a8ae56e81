"""Verdicts against known truth, expert scores, and checked source pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import base_name, stem

EXPERT_WEIGHTS = {"anatomy": 0.25, "texture": 0.25, "contrast": 0.20, "artifact": 0.20, "overall": 0.10}


def truth_label(image: Column) -> Column:
    """good or bad by the file name's prefix, else null."""
    name = F.lower(base_name(image))
    return F.when(name.startswith("good_"), "good").when(name.startswith("bad_"), "bad")


def bad_category(image: Column) -> Column:
    """Second part of a bad file's name, 'generic' without one, '' for others."""
    s = F.lower(stem(image))
    rest = F.substring(s, 5, F.length(s))
    return F.when(~s.startswith("bad_"), "").when(F.instr(rest, "_") > 0, F.substring_index(rest, "_", 1)).otherwise("generic")


def judged(rows: DataFrame) -> DataFrame:
    """Adds label, category, stopped: not ok, or not of the first tier."""
    return rows.withColumns({"label": truth_label(F.col("image")), "category": bad_category(F.col("image")), "stopped": ~F.col("ok") | (F.col("tier") >= 2)})


def metrics(rows: DataFrame) -> DataFrame:
    """Counts, recall of bad ones and share of good ones stopped, in one row."""
    r = judged(rows)
    bad, good, stopped = F.col("label") == "bad", F.col("label") == "good", F.col("stopped")
    counts = r.agg(
        F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad"), F.count_if(F.col("label").isNull()).alias("n_unlabeled"),
        F.count_if(bad & stopped).alias("bad_hits"), F.count_if(bad & ~stopped).alias("bad_misses"), F.count_if(good & stopped).alias("false_kills"),
    )
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), b), 6), F.lit(0.0))
    return counts.withColumns({"veto_recall": rate("bad_hits", F.col("n_bad")), "false_kill_rate": rate("false_kills", F.col("n_good"))})


def misses(rows: DataFrame) -> DataFrame:
    """(label, image): bad ones that were not stopped and good ones that were, a row each."""
    wrong = judged(rows).filter(((F.col("label") == "bad") & ~F.col("stopped")) | ((F.col("label") == "good") & F.col("stopped")))
    return wrong.select("label", base_name(F.col("image")).alias("image"))


def by_category(rows: DataFrame) -> DataFrame:
    bad = judged(rows).filter("label = 'bad' and category <> ''")
    return bad.groupBy("category").agg(F.count_if("stopped").alias("hit"), F.count_if(~F.col("stopped")).alias("miss"))


def top_purity(rows: DataFrame, k: int = 5) -> DataFrame:
    """Whether the first k labelled rows are all good, ok and of the first tier. Fewer than k: no."""
    first = judged(rows).filter("label is not null").orderBy("tier", F.desc("final_rank_score"), "image").limit(k)
    pure = (F.col("label") == "good") & F.col("ok") & (F.col("tier") == 1)
    return first.agg((F.coalesce(F.bool_and(pure), F.lit(False)) & (F.count("*") == k)).alias("pure"), F.array_join(F.array_sort(F.collect_list("image")), ",").alias("images"))


def with_presets(rows: DataFrame, presets: DataFrame, key: str) -> DataFrame:
    """Scores given as text; those missing or unreadable are 3."""
    joined = rows.join(presets, key, "left")
    return joined.withColumns({d: F.coalesce(F.col(d).try_cast("double"), F.lit(3.0)) for d in EXPERT_WEIGHTS})


def weighted(rows: DataFrame) -> DataFrame:
    total = sum((F.col(d) * w for d, w in list(EXPERT_WEIGHTS.items())[1:]), F.col("anatomy") * EXPERT_WEIGHTS["anatomy"])
    return rows.withColumn("weighted_total", F.round(total, 2))


def yes_no(reply: Column) -> Column:
    """True for YES only, false for NO only, null for both or neither."""
    text = F.upper(reply)
    yes, no = text.contains("YES"), text.contains("NO")
    return F.when(yes & ~no, True).when(no & ~yes, False)


def split_by_cache(pool: DataFrame, cache: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached verdict, rows still to be scored)."""
    return pool.join(cache, signature), pool.join(cache, signature, "left_anti")


def topped_up(approved: DataFrame, unchecked: DataFrame, key: str, n: int) -> DataFrame:
    """Approved rows, then unchecked ones up to n, by key."""
    both = approved.select(key, F.lit(0).alias("priority")).union(unchecked.select(key, F.lit(1)))
    return both.orderBy("priority", key).limit(n)


def settled_slots(draws: DataFrame, slots: list, order: str, verdict: str, certain: tuple) -> DataFrame:
    """Per slot the first draw with a certain verdict, else the last draw, marked as a fallback."""
    w = Window.partitionBy(*slots)
    good = F.col(verdict).isin(*certain)
    first = F.min(F.when(good, F.col(order))).over(w)
    last = F.max(order).over(w)
    rows = draws.withColumns({"first": first, "last": last}).filter(F.col(order) == F.coalesce("first", "last"))
    return rows.withColumn("action", F.when(F.col("first").isNull(), "fallback_strip_uncertain").otherwise(F.col(verdict))).drop("first", "last")
