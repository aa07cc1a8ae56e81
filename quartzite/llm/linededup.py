"""Cross-site line deduplication by distinct-site spread.

Lines (split at \n; outer spaces and carriage returns do not count) are hashed to 128 bits. Per hash a HyperLogLog sketch of the
sites it stands on is merged by aggregation. Estimates clearly over or under the threshold decide; lines
near it get an exact distinct count. A line spread over at least min_sites sites is boilerplate: it stays
where it comes first (least doc_id, then place in the text) and goes everywhere else, so whole copied
documents lose their repeats but no passage vanishes altogether. Line breaks are never lines, so a blank
line stays as it is. A long line can have a threshold of its own (long_sites); it then has to stand in
different texts too, so that copies of a whole document are left to the step that drops documents.

Only hashes are shuffled for counting. The list of places to drop is settled; Catalyst broadcasts it where
it is small and else joins by document.

Nulls: a null text stays null with 0 lines, a null source is a site of its own, rows with a null doc_id
count as documents and come last. Rows that share doc_id and text are one document and are treated alike.
An empty table gives no rows. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, settled

LG_K = 12
NEAR = 0.1
#: Words from which a line is long.
LONG_LINE = 50


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    """A line without outer spaces and carriage returns; few lines have one, and plain trimming is quicker."""
    return F.when(F.contains(line, F.lit("\r")), F.trim(line, F.lit(" \r"))).otherwise(F.trim(line))


def line_rows(docs: DataFrame, with_long: bool = True) -> DataFrame:
    """(doc_id, tag, site, pos, h1, h2, long), one row per line that is not blank. long: whether it has LONG_LINE
    words, which are counted only where it has the characters for them (with_long; else false)."""

    def hashes(x: Column) -> Column:
        long = F.when(F.length(x) >= 2 * LONG_LINE - 1, n_words(x) >= LONG_LINE).otherwise(False) if with_long else F.lit(False)
        return F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"), long.alias("long")))

    hashed = F.transform(F.transform(lines_of(F.col("text")), bare), hashes)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.coalesce(F.col("source"), F.lit("\0none")).alias("site"), F.posexplode(hashed).alias("pos", "h"))
    return rows.filter("h is not null").select("doc_id", "tag", "site", "pos", "h.h1", "h.h2", "h.long")


def spread_lines(rows: DataFrame, min_sites: int, long_sites: int | None = None, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """(h1, h2, first) of the lines on at least min_sites sites, and of the long ones in several texts on at
    least long_sites. Sites are hashed for the sketch, which does not count an empty string."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("pos"), F.col("tag"))
    sketch = F.hll_sketch_agg(F.xxhash64("site"), lg_k).alias("sketch")
    if long_sites is None:
        counted = rows.groupBy("h1", "h2").agg(sketch, F.min(place).alias("first"))
        need = F.lit(min_sites)
    else:
        counted = rows.groupBy("h1", "h2").agg(sketch, F.min(place).alias("first"), F.max("long").alias("long"), F.min("tag").alias("low"), F.max("tag").alias("high"))
        need = F.when(F.col("long") & (F.col("low") != F.col("high")), F.lit(min(long_sites, min_sites))).otherwise(F.lit(min_sites))
    counted = counted.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"), need.alias("need"))
    counted = settled(counted.filter(F.col("sites") >= F.col("need") * (1 - near)), "lines-spread")
    over = F.col("sites") > F.col("need") * (1 + near)
    close = counted.filter(~over)
    exact = rows.join(close.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
    sure = close.join(exact, ["h1", "h2"]).filter(F.col("n") >= F.col("need"))
    return counted.filter(over).select("h1", "h2", "first").union(sure.select("h1", "h2", "first"))


def cleaned(docs: DataFrame, min_sites: int, long_sites: int | None = None) -> DataFrame:
    """(d, text, n_lines, n_dropped): d is the row but for its text, packed so that none of its columns can clash."""
    rows = line_rows(docs, long_sites is not None)
    spread = settled(spread_lines(rows, min_sites, long_sites), "lines-boilerplate")
    here = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("pos"), F.col("tag"))
    gone = rows.join(spread, ["h1", "h2"]).filter(~here.eqNullSafe(F.col("first")))
    places = settled(gone.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("at")), "lines-dropped")
    # The lines come out of the join as a column of their own: picking one by its place then costs nothing.
    others = [F.col(c).alias(c) for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("d"), lines_of(F.col("text")).alias("lines"), F.xxhash64("text").alias("text_tag"))
    joined = packed.join(places, F.col("d.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("text_tag") == F.col("tag")), "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("at").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(every, "at"), lambda i: F.col("lines")[i]))
    return joined.select(
        "d",
        F.array_join(kept, "\n").alias("text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size(F.filter(F.transform("lines", bare), lambda x: x != ""))).cast("long").alias("n_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_dropped"),
    )


def drop_spread_lines(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """docs, text without the lines that are dropped, and n_lines, n_dropped (which replace columns of
    these names)."""
    keep = [F.col("text") if c == "text" else F.col("d")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cleaned(docs, min_sites).select(*keep, "n_lines", "n_dropped")
