"""Captions from a row's classes, and balanced draws of rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

# The phrases of captions.
DENSITY_TEXT = {"fatty": "fatty breast tissue", "scattered": "scattered fibroglandular density", "heterogeneous": "heterogeneously dense breast tissue", "dense": "extremely dense breast tissue"}
VIEW_TEXT = {"CC": "craniocaudal view", "MLO": "mediolateral oblique view"}
SIDE_TEXT = {"LEFT": "left breast", "RIGHT": "right breast"}
ANATOMY = ["skin line", "nipple in profile", "breast contour", "fibroglandular tissue", "radiographic texture"]
TEXT_FREE = ["no text", "no labels", "no annotations", "no DICOM markers", "no alphanumeric overlay", "clean diagnostic image"]
CLOSING = ["grayscale", "high contrast", "medical imaging", "radiograph", "diagnostic quality"]
NEGATIVE_CAPTION = "chest x-ray, lung, rib, ribcage, heart, spine, bone, skeletal, ultrasound, sonography, ct scan, mri, natural image, color image, collage, tiled, grid, seams, patchwork, not mammography"
FINDING_DENSITY = {"1": "almost entirely fatty tissue", "2": "scattered fibroglandular density", "3": "heterogeneously dense breast", "4": "extremely dense breast", "A": "almost entirely fatty tissue", "B": "scattered fibroglandular density", "C": "heterogeneously dense breast", "D": "extremely dense breast"}
FINDING_VIEW = {"MLO": "mediolateral oblique", "CC": "craniocaudal", "LM": "lateromedial", "ML": "mediolateral"}
FIXED_DENSITY = DENSITY_TEXT | {"fatty": "predominantly fatty breast tissue"}
PROMPT_ANATOMY = "triangular pectoralis muscle, clear inframammary fold, directional fibroglandular strands toward nipple"
VIEW_EXTRA = {"MLO": "pectoral muscle", "other": "compressed breast tissue"}
FIXED_OPENING = "mammography, mediolateral oblique view, "
FINDING_FORM = "a mammography X-ray image of the %s breast, %s view, %s, %s, grayscale medical imaging, diagnostic quality"
FINDING_PARTS = {"malignant": "malignant lesion", "benign": "benign finding", "mass": "breast mass", "calc": "microcalcifications", "none": "no significant abnormality"}
PROMPT_VIEW = {"MLO": "MLO view", "CC": "CC view"}
PROMPT_FORM = "medical grayscale mammogram, %s, fine ligament texture, FFDM, no text, no labels"


def phrase(values: dict, key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def structured(view: Column, side: Column, density: Column) -> Column:
    """The phrases in order, with one more for the view at the sixth place."""
    pieces = F.array(F.lit("mammography"), phrase(VIEW_TEXT, F.upper(view), "mammogram view"), phrase(SIDE_TEXT, F.upper(side), "breast"), phrase(DENSITY_TEXT, density, "fibroglandular density"), *[F.lit(x) for x in ANATOMY + TEXT_FREE + CLOSING])
    extra = phrase(VIEW_EXTRA, F.upper(view), VIEW_EXTRA["other"])
    return F.array_join(F.array_insert(pieces, 6, extra), ", ")


def fixed_view(side: Column, density: Column) -> Column:
    """The caption of a set that holds oblique views only."""
    closing = ", " + ", ".join(["skin line", "pectoral muscle", *ANATOMY[1:], *TEXT_FREE, *CLOSING])
    return F.concat(F.lit(FIXED_OPENING), phrase(SIDE_TEXT, F.upper(side), "breast"), F.lit(", "), phrase(FIXED_DENSITY, density, "breast tissue"), F.lit(closing))


def findings(side: Column, view: Column, density: Column, pathology: Column, abnormality: Column) -> Column:
    side_text = F.when(F.upper(side).isin("L", "LEFT"), "left").when(F.upper(side).isin("R", "RIGHT"), "right").otherwise("bilateral")
    view_text = phrase(FINDING_VIEW, F.element_at(F.split(F.upper(view), "_"), 1), "mammogram")
    what = F.lower(F.coalesce(pathology, F.lit("")))
    kind = F.lower(F.coalesce(abnormality, F.lit("")))
    first = lambda text, *names: F.coalesce(*[F.when(text.contains(n), FINDING_PARTS[n]) for n in names])
    parts = F.array_compact(F.array(first(what, "malignant", "benign"), first(kind, "mass", "calc")))
    found = F.when(F.size(parts) == 0, FINDING_PARTS["none"]).otherwise(F.array_join(parts, ", "))
    return F.format_string(FINDING_FORM, side_text, view_text, phrase(FINDING_DENSITY, density, "fibroglandular density"), found)


def prompt(view: Column, density: Column, base: Column) -> Column:
    """The prompt in the words of the captions; an unknown density keeps the base prompt."""
    view_part = F.try_element_at(F.create_map(*[F.lit(x) for kv in PROMPT_VIEW.items() for x in kv]), F.upper(view))
    anatomy = F.when(F.upper(view) == "MLO", PROMPT_ANATOMY)
    parts = F.concat_ws(" ", view_part, F.concat(density, F.lit(" density")), anatomy)
    return F.when(F.lower(density).isin(*DENSITY_TEXT), F.format_string(PROMPT_FORM, parts)).otherwise(base)


def hash_order(key: Column, seed: str) -> Column:
    """An order that looks random and is the same however rows are dealt."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def numbered(rows: DataFrame, strata: list, key: str, order: Column) -> DataFrame:
    """Rows with k, their place in their stratum, and n, its size. Rows are dealt into ranges of (stratum, order),
    which are written; each range is numbered on its own and the counts of the ranges before it are added, so a
    stratum of any size is spread over tasks. What runs over all counts has a row per range and stratum."""
    dealt = rows.withColumn("__order", order)
    dealt = dealt.repartitionByRange(*[F.col(s) for s in strata], F.col("__order"), F.col(key)).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "strata")
    counts = stored(dealt.groupBy(*strata, "__part").agg(F.count("*").alias("__here")), "strata-counts")
    w = Window.partitionBy(*strata)
    totals = counts.withColumns({"__before": F.sum("__here").over(w.orderBy("__part")) - F.col("__here"), "n": F.sum("__here").over(w)}).drop("__here")
    totals = totals.select(*[F.col(s).alias(f"__{s}") for s in strata], F.col("__part").alias("__of"), "__before", "n")
    same = F.col("__part") == F.col("__of")
    for s in strata:
        same &= F.col(s).eqNullSafe(F.col(f"__{s}"))
    place = F.row_number().over(Window.partitionBy(*strata, "__part").orderBy("__order", key))
    return dealt.withColumn("__place", place).join(totals, same).withColumn("k", F.col("__place") + F.col("__before")).select(*rows.columns, "k", "n")


#: Slots that one task makes at a time.
SLOTS = 100_000


def oversampled(rows: DataFrame, strata: list, key: str, seed: str = "2026") -> DataFrame:
    """Every row, and repeats up to the size of the largest stratum. Slot s beyond a stratum's n rows takes the
    row whose place is given by a hash of stratum and slot. Adds slot."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    target = sizes.agg(F.max("n").alias("target"))
    name = F.concat_ws("|", *strata)
    runs_ = sizes.crossJoin(F.broadcast(target)).filter("target > n").withColumn("from", F.explode(F.sequence(F.col("n") + 1, F.col("target"), F.lit(SLOTS).cast("long"))))
    extra = runs_.repartition(*strata, "from").withColumn("slot", F.explode(F.sequence(F.col("from"), F.least(F.col("target"), F.col("from") + (SLOTS - 1))))).drop("from")
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n") + 1
    places = numbered(rows, strata, key, F.col(key)).drop("n")
    repeats = extra.select(*strata, "slot", pick.alias("k")).join(places, [*strata, "k"]).drop("k")
    return places.withColumnRenamed("k", "slot").select(*rows.columns, "slot").unionByName(repeats.select(*rows.columns, "slot"))


def to_target(rows: DataFrame, strata: list, key: str, target: int) -> DataFrame:
    """Exactly target rows a stratum: the first ones by key, or all of them over and over. Adds slot (from 0). Only the first
    `target` rows of each stratum are moved (the filter on the rank is a limit per group before the shuffle), and strata
    meet their sizes as `target` rows each."""
    sizes = rows.groupBy(*[F.col(s).alias(f"__{s}") for s in strata]).agg(F.count("*").alias("n"))
    places = rows.withColumn("k", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).filter(F.col("k") <= target)
    same = functools.reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata])
    places = places.join(sizes, same)
    times = F.ceil((F.lit(target) - (F.col("k") - 1)) / F.least(F.col("n"), F.lit(target))).cast("int")
    copies = places.withColumn("round", F.explode(F.sequence(F.lit(0), times - 1)))
    return copies.withColumn("slot", F.col("k") - 1 + F.col("round") * F.col("n")).select(*rows.columns, "slot")


#: Characters of the pieces by which names are looked up.
GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct pieces of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def last_containing(names: DataFrame, name: str, runs: DataFrame, run: str) -> DataFrame:
    """Each name with the last run, by name, that contains it. A name is looked up by one piece of GRAM characters, the one
    that the fewest runs have (a shorter name by itself), and what shares it is checked. A run has as many pieces as
    characters, times GRAM at most, whatever lengths names have. An empty name is in every run; a null one in none, and
    a null run holds nothing. Repeated names each come out."""
    known = runs.select(F.col(run).alias("__run")).filter("__run is not null").distinct()
    pieces = F.flatten(F.array(*[grams(F.col("__run"), n) for n in range(1, GRAM + 1)]))
    cut = stored(known.select("__run", F.explode(pieces).alias("__piece")), "run-pieces")
    rare = cut.groupBy("__piece").agg(F.count("*").alias("__runs"))
    asked = names.select(F.col(name).alias("__name")).filter("__name <> ''").distinct()
    of_name = F.when(F.length("__name") < GRAM, F.array("__name")).otherwise(grams(F.col("__name"), GRAM))
    keyed = asked.select("__name", F.explode(of_name).alias("__piece")).join(rare, "__piece", "left")
    # A piece that no run has rules all runs out.
    keyed = keyed.groupBy("__name").agg(F.min_by("__piece", F.coalesce("__runs", F.lit(0))).alias("__piece"))
    found = keyed.join(cut, "__piece").filter(F.contains("__run", "__name")).groupBy("__name").agg(F.max("__run").alias(run))
    every = known.agg(F.max("__run").alias(run)).select(F.lit("").alias("__name"), run)
    return names.join(found.union(every), F.col(name) == F.col("__name"), "left").select(name, run)
