"""A baseline that grows by arrivals, with exact percentiles, and the versions of the thresholds that follow from it.

Kept in a folder, all append-only: for each arrival its values in long form with the bin of each, rows per bin, moments, and a
KLL sketch per metric. Bins are cut at quantiles of the sketch of what came before, so each holds a small share.
Exact counts of the bins say in which bin a wanted rank lies and how many rows come before it; only rows of those bins are
read (each task writes its values sorted by metric and bin, and the bins are literals of the filter, so Parquet
skips the other pages). An arrival costs two passes over its own rows, one for the sketch, and no shuffle of them. When values drift and a wanted bin holds many times its
share, bins are cut anew at the quantiles of the merged sketches, and the values are written once more: a new epoch.

An arrival counts from the moment its line is in the manifest, which is written last; one that failed half-way is
written again, one that comes again adds nothing. One writer at a time.

Nulls are not counted. NaN counts as greater than all numbers. An arrival without rows is noted and adds nothing.
A metric that appears later starts in one bin. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grading import PLACES, POINTS

MANIFEST = "epoch int, nth int, arrival string"
VALUES, COUNTS = "metric string, bin int, value double", "metric string, bin int, n long, lo double, hi double"
MOMENTS, SKETCHES = "metric string, n long, mean double, m2 double", "metric string, sketch binary"


class GrowingBaseline:
    """path: a folder of the shared store. metrics: columns of what arrives. bins: into how many parts a metric is cut.
    size: the sketch's parameter k. heavy: bins are cut anew when a wanted one holds so many times its share."""

    def __init__(self, spark: SparkSession, path: str, metrics: list[str], bins: int = 256, size: int = 2048, heavy: float = 8.0):
        self.spark, self.path, self.metrics = spark, path.rstrip("/"), list(metrics)
        self.bins, self.size, self.heavy = bins, size, heavy

    def manifest(self) -> tuple[int, list[str]]:
        """The epoch, and the arrivals in it, in order."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return 0, []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()
        epoch = max((r.epoch for r in rows), default=0)
        return epoch, [r.arrival for r in sorted(rows) if r.epoch == epoch]

    def note(self, epoch: int, arrivals: list[str], first: int = 0) -> None:
        self.spark.createDataFrame([(epoch, first + i, a) for i, a in enumerate(arrivals)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, kind: str, schema: str, epoch: int, arrivals: list[str]) -> DataFrame:
        paths = [f"{self.path}/{epoch}/{kind}/{a}" for a in arrivals]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def edges(self, epoch: int, arrivals: list[str]) -> dict[str, np.ndarray]:
        """Of each metric the borders of its bins: at most metrics x bins numbers. They follow from the first arrival
        of the epoch, which keeps them."""
        rows = self.read("edges", "metric string, edges array<double>", epoch, arrivals[:1]).collect()
        return {r.metric: np.array(r.edges) for r in rows}

    def sketched(self, long: DataFrame) -> DataFrame:
        return long.groupBy("metric").agg(F.kll_sketch_agg_double("value", F.lit(self.size)).alias("sketch"))

    def write(self, frame: DataFrame, kind: str, epoch: int, arrival: str) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/{epoch}/{kind}/{arrival}")

    def cut(self, sketches: DataFrame, epoch: int, arrival: str) -> dict[str, np.ndarray]:
        at = F.array(*[F.lit(i / self.bins) for i in range(1, self.bins)])
        self.write(sketches.select("metric", F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("sketch", at))).alias("edges")).coalesce(1), "edges", epoch, arrival)
        return self.edges(epoch, [arrival])

    def keep(self, long: DataFrame, edges: dict[str, np.ndarray], epoch: int, arrival: str) -> None:
        """Values with their bins, and rows per bin. A bin ends at its border, which belongs to it."""

        @F.pandas_udf("int")
        def bin_of(metric: pd.Series, value: pd.Series) -> pd.Series:
            out = np.zeros(len(value), np.int32)
            for m, at in metric.groupby(metric).indices.items():
                out[at] = np.searchsorted(edges.get(m, np.zeros(0)), value.to_numpy()[at], "left")
            return pd.Series(out)

        binned = long.select("metric", bin_of("metric", "value").alias("bin"), "value")
        self.write(binned.sortWithinPartitions("metric", "bin"), "values", epoch, arrival)
        values = self.read("values", VALUES, epoch, [arrival])
        self.write(values.groupBy("metric", "bin").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).coalesce(1), "counts", epoch, arrival)

    def add(self, rows: DataFrame, arrival: str) -> bool:
        """Take in an arrival; False if it is there already."""
        epoch, arrivals = self.manifest()
        if arrival in arrivals:
            return False
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in self.metrics)
        long = rows.select(F.expr(f"stack({len(self.metrics)}, {pairs}) as (metric, value)")).filter("value is not null")
        self.write(self.sketched(long).coalesce(1), "sketches", epoch, arrival)
        edges = self.edges(epoch, arrivals) if arrivals else self.cut(self.read("sketches", SKETCHES, epoch, [arrival]), epoch, arrival)
        self.keep(long, edges, epoch, arrival)
        m2 = F.var_pop("value") * F.count("value")
        self.write(self.read("values", VALUES, epoch, [arrival]).groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), m2.alias("m2")).coalesce(1), "moments", epoch, arrival)
        self.note(epoch, [arrival], len(arrivals))
        if any(h > self.heavy for h in self.weights().values()):
            self.recut()
        return True

    def counted(self) -> dict[str, list[tuple[int, int, float, float]]]:
        """Of each metric (bin, rows, least, greatest) of its bins, in order."""
        epoch, arrivals = self.manifest()
        counts = self.read("counts", COUNTS, epoch, arrivals).groupBy("metric", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out: dict[str, list] = {}
        for r in sorted(counts.collect()):  # at most metrics x bins rows
            out.setdefault(r.metric, []).append((r.bin, r.n, r.lo, r.hi))
        return out

    def targets(self, counted: dict) -> list[tuple[str, str, float, int, int, int, int]]:
        """(metric, point, share above the lower rank, bin and place in it of the lower rank, the same of the upper)."""
        out = []
        for metric, bins in counted.items():
            ends = np.cumsum([n for _, n, _, _ in bins])
            for point, q in POINTS.items():
                at = q * (int(ends[-1]) - 1)
                ranks = [math.floor(at), math.ceil(at)]
                i = np.searchsorted(ends, ranks, "right")
                out.append((metric, point, at - ranks[0], *[int(x) for k in (0, 1) for x in (bins[i[k]][0], ranks[k] - (ends[i[k]] - bins[i[k]][1]))]))
        return out

    def weights(self) -> dict[tuple[str, int], float]:
        """Of the wanted bins that hold more than one value, how many times the share of a bin they hold."""
        counted = self.counted()
        wanted = {(t[0], b) for t in self.targets(counted) for b in (t[3], t[5])}
        return {(m, b): n * self.bins / sum(x[1] for x in bins) for m, bins in counted.items() for b, n, lo, hi in bins if (m, b) in wanted and lo < hi}

    def recut(self) -> None:
        """A new epoch: all values, in bins by the merged sketches, as one arrival under the name of the first."""
        epoch, arrivals = self.manifest()
        first = arrivals[0]
        merged = self.read("sketches", SKETCHES, epoch, arrivals).groupBy("metric").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
        self.write(merged.coalesce(1), "sketches", epoch + 1, first)
        edges = self.cut(self.read("sketches", SKETCHES, epoch + 1, [first]), epoch + 1, first)
        self.keep(self.read("values", VALUES, epoch, arrivals).select("metric", "value"), edges, epoch + 1, first)
        self.write(self.moments(epoch, arrivals).coalesce(1), "moments", epoch + 1, first)
        for other in arrivals[1:]:  # they are in the first's tables now
            for kind, schema in (("values", VALUES), ("counts", COUNTS), ("moments", MOMENTS), ("sketches", SKETCHES)):
                self.write(self.spark.createDataFrame([], schema), kind, epoch + 1, other)
        self.note(epoch + 1, arrivals)

    def moments(self, epoch: int, arrivals: list[str]) -> DataFrame:
        """metric, n, mean, m2 of all arrivals, put together from those of each."""
        each = self.read("moments", MOMENTS, epoch, arrivals)
        whole = each.groupBy("metric").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
        apart = F.sum(F.col("m2") + F.col("each") * (F.col("mean") - F.col("all")) ** 2)
        return each.withColumnRenamed("n", "each").join(whole, "metric").groupBy("metric").agg(F.first("n").alias("n"), F.first("all").alias("mean"), apart.alias("m2"))

    def bracketed(self, targets: list) -> DataFrame:
        """The values of the wanted bins."""
        epoch, arrivals = self.manifest()
        bins: dict[str, set[int]] = {}
        for t in targets:
            bins.setdefault(t[0], set()).update((t[3], t[5]))
        wanted = F.lit(False)
        for m, b in bins.items():
            wanted = wanted | ((F.col("metric") == m) & F.col("bin").isin(sorted(b)))
        return self.read("values", VALUES, epoch, arrivals).filter(wanted)

    def stats(self) -> DataFrame:
        """metric, n, p1 ... p99 (exact, linear between neighbours), mean, std (of the population) of all that has arrived."""
        epoch, arrivals = self.manifest()
        targets = self.targets(self.counted())
        wanted = self.spark.createDataFrame(targets, "metric string, point string, share double, bin0 int, place0 long, bin1 int, place1 long")
        values = self.bracketed(targets).groupBy("metric", "bin", "value").agg(F.count("*").alias("c"))
        upto = values.withColumn("upto", F.sum("c").over(Window.partitionBy("metric", "bin").orderBy("value")))
        ends = wanted.select("metric", "point", "share", F.explode(F.array(*[F.struct(F.lit(k).alias("end"), F.col(f"bin{k}").alias("bin"), F.col(f"place{k}").alias("place")) for k in (0, 1)])).alias("e"))
        ends = ends.select("metric", "point", "share", "e.end", "e.bin", "e.place")
        at = F.min(F.when(F.col("upto") > F.col("place"), F.col("value")))
        found = upto.join(F.broadcast(ends), ["metric", "bin"]).groupBy("metric", "point", "share", "end").agg(at.alias("v"))  # ends: points x metrics x 2 rows
        side = lambda k: F.max(F.when(F.col("end") == k, F.col("v")))
        lines = found.groupBy("metric", "point", "share").agg(side(0).alias("a"), side(1).alias("b")).withColumn("v", F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
        points = lines.groupBy("metric").agg(*[F.round(F.max(F.when(F.col("point") == p, F.col("v"))), PLACES).alias(p) for p in POINTS])
        moments = self.moments(epoch, arrivals).select("metric", "n", F.round("mean", PLACES).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), PLACES).alias("std"))
        return moments.join(points, "metric").select("metric", "n", *POINTS, "mean", "std")


HISTORY = "limit string, value double, source string, valid_from long, valid_to long"


def new_version(history: DataFrame, limits: DataFrame, at: int) -> DataFrame:
    """history (see HISTORY; valid_to null: in force) after the limits of time `at` (limit, value, source) came in: a limit with
    another value, or that is new or gone, ends the row in force and begins one. A version without a change, so also one that
    comes again, leaves history as it is. Values are compared null-safe. Versions come in order of time; a change
    before the last one is an error."""
    now = history.filter("valid_to is null").select(F.col("limit").alias("old_limit"), F.col("value").alias("old"))
    both = now.join(limits.select("limit", "value", "source"), F.col("old_limit").eqNullSafe(F.col("limit")), "full_outer")
    same = F.col("old_limit").isNotNull() & F.col("limit").isNotNull() & F.col("old").eqNullSafe(F.col("value"))
    changed = both.filter(~same)
    last = history.agg(F.max(F.greatest("valid_from", "valid_to"))).first()[0]
    if last is not None and last >= at and changed.limit(1).count():
        raise ValueError(f"a change at {at} is not after the last one, at {last}")
    ended = changed.filter("old_limit is not null").select(F.col("old_limit").alias("limit"), F.lit(at).cast("long").alias("ends"))
    kept = history.join(ended, "limit", "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("ends")).otherwise(F.col("valid_to"))).drop("ends")
    begun = changed.filter("limit is not null").select("limit", "value", "source", F.lit(at).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return kept.select(*begun.columns).unionByName(begun)


def change_record(history: DataFrame) -> DataFrame:
    """limit, valid_from, old, new, source: a row per change of a limit that was there before or is there after."""
    w = Window.partitionBy("limit").orderBy("valid_from")
    before = F.when(F.lag("valid_to").over(w) == F.col("valid_from"), F.lag("value").over(w))
    begun = history.select("limit", "valid_from", before.alias("old"), F.col("value").alias("new"), "source")
    gone = history.select("limit", "valid_to", "value", F.lead("valid_from").over(w).alias("next")).filter("valid_to is not null and (next is null or next > valid_to)")
    return begun.unionByName(gone.select("limit", F.col("valid_to").alias("valid_from"), F.col("value").alias("old"), F.lit(None).cast("double").alias("new"), F.lit("gone").alias("source")))
