"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source, documents stand in the order of their keys; prefix
sums of sizes along that order say which documents a budget covers. A target above a source's size repeats
whole epochs and cuts the last one. The order is cut into ranges of the key: sizes are summed per (source,
range), prefix sums run over those few sums, and only the one range of each source that holds the cut is
looked at row by row. A source has a range for every few thousand documents, so no source, however large, is
sorted in one task.

Nulls: a null text has size 0, a null source is a source of its own that comes last, a null doc_id is
hashed as an empty string, with its text. Repeated rows count each for itself. Empty tables give empty results. Sizes of 0
are never taken. Other columns are ignored (or kept, where documents are returned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settled

RANGE_ROWS = 4_000
SEED = "mix"


def mix_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A hash of id and text, so that rows without an id, or with one id, are spread too."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: (source, source_size, ...). Adds weight and target. The targets add up to share times all sizes;
    a target stops at most times its source's size, and what is over goes to the others by weight until
    none is above. With the sources in order of size / weight, the stopped ones come first, so the level of
    the others is a ratio of running sums, and the first level that its own source can take is the one. One row per source: the windows see nothing else."""
    w_all = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(w_all) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(most), "ratio": F.col("source_size") * F.lit(most) / F.col("weight")})
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    stepped = ranked.withColumn("level", level)
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    return stepped.withColumn("final", final).withColumn("target", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("final") * F.col("weight"))).drop("cap", "ratio", "level", "final")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, key), as narrow as can be."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text"), seed).alias("key"))


def with_range(rows: DataFrame) -> DataFrame:
    """The key's place among equal parts of the key space, as many as the row's `ranges` says."""
    return rows.withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.col("ranges")).cast("int"))


def cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ranges, target, epochs (whole passes), rest (words of the last, partial pass), cut_part (the
    range in which rest runs out) and before (words in the ranges ahead of it)."""
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("part")
    pieces = sums.select(F.col("source").alias("of"), "part", F.sum("words").over(running).alias("upto"), "words")
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", rest.cast("long"))
    same = F.col("source").eqNullSafe(F.col("of"))
    hit = plan.join(pieces, same).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    first = hit.groupBy("of").agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    out = plan.join(first, same, "left")
    return out.select("source", "source_size", "ranges", "target", "epochs", "rest", F.coalesce("cut.part", "ranges").alias("cut_part"), F.coalesce("cut.before", F.lit(0)).alias("before"))


def mixed(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, plan). rows: doc_id, source, size, source_size, target, taken, where the cut is exact: the
    document in which a budget runs out is taken in part. plan: one row per source for whole_documents()."""
    rows = settled(sized(docs, seed), "mix-sizes")
    sizes = settled(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    parts = F.ceil(F.col("n") / RANGE_ROWS).cast("int").alias("ranges")
    targets = settled(source_targets(sizes.select("source", "source_size", parts), weights, share, most), "mix-targets")
    rows = with_range(rows.join(targets.select(F.col("source").alias("of"), "ranges"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    plan = settled(cuts(rows, targets), "mix-cuts")
    rows = rows.drop("ranges")
    p = plan.withColumnRenamed("source", "of")
    both = rows.join(p, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = both.filter(F.col("part") != F.col("cut_part")).withColumn("extra", F.when(F.col("part") < F.col("cut_part"), F.col("size")).otherwise(F.lit(0)).cast("long")).withColumn("prefix", F.lit(None).cast("long"))
    along = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = F.sum("size").over(along) - F.col("size") + F.col("before")
    cut = both.filter(F.col("part") == F.col("cut_part")).withColumn("prefix", prefix)
    cut = cut.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("prefix"))).cast("long"))
    every = whole.unionByName(cut).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long"))
    last = cut.filter((F.col("prefix") + F.col("size") / 2 <= F.col("rest")) & (F.col("size") > 0)).groupBy("source").agg(F.max("key").alias("last_key"))
    per_source = p.join(last, F.col("of").eqNullSafe(F.col("source")), "left").drop("source")
    return every.select("doc_id", "source", "size", "source_size", "target", "taken"), per_source


def whole_documents(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as documents: each repeated as often as its source's plan says. Documents stay whole, so the
    one at the cut is taken if at least half of it is covered. The plan is settled, which tells Catalyst
    its size: small, it is broadcast, and the texts are not shuffled."""
    plan = settled(plan, "mix-plan")
    packed = docs.select(F.struct(*docs.columns).alias("d"), mix_key(F.col("doc_id"), F.col("text"), seed).alias("key"), n_words(F.col("text")).alias("size"))
    joined = with_range(packed.join(plan, F.col("d.source").eqNullSafe(F.col("of"))))
    in_last = (F.col("part") < F.col("cut_part")) | ((F.col("part") == F.col("cut_part")) & (F.col("key") <= F.coalesce("last_key", F.lit(""))))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.when(in_last, 1).otherwise(0)).otherwise(0).cast("int")
    return joined.select("d", F.explode(F.array_repeat(F.lit(1), times))).select("d.*")
