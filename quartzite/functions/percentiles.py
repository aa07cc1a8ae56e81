"""Exact percentiles of groups of any size.

The built-in exact percentile keeps a counter per distinct value of a group in one task. Here an approximate
pass brackets each percentile between two values of the data; a second pass counts what lies under each
bracket and takes the rows inside it, a few ten-thousandths of the group, and the wanted ranks are read off
their running counts. The values next to a bracket are kept too, so that rounding of ranks in small groups
cannot miss."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def exact_percentiles(rows: DataFrame, key: str, value: str, points: dict, accuracy: int = 10_000) -> DataFrame:
    """key and one column per point (name -> share), linear between neighbours; nulls are not counted."""
    names, eps = list(points), 2.0 / accuracy
    low = F.array(*[F.lit(max(0.0, q - eps)) for q in points.values()])
    high = F.array(*[F.lit(min(1.0, q + eps)) for q in points.values()])
    rows = rows.select(F.col(key), F.col(value).cast("double").alias("v")).filter("v is not null")
    brackets = rows.groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx("v", low, accuracy).alias("lo"), F.percentile_approx("v", high, accuracy).alias("hi"))
    brackets = stored(brackets, "brackets")  # a row per group
    both = rows.join(brackets, key)
    v = F.col("v")

    def sides(i: int) -> list[Column]:
        lo, hi = F.col("lo")[i], F.col("hi")[i]
        return [F.count_if(v < lo).alias(f"below{i}"), F.max(F.when(v < lo, v)).alias(f"before{i}"), F.min(F.when(v > hi, v)).alias(f"after{i}")]

    outside = both.groupBy(key, "n").agg(*[c for i in range(len(names)) for c in sides(i)])
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(points[x]).alias("q"), F.col(f"below{i}").alias("below"), F.col(f"before{i}").alias("before"), F.col(f"after{i}").alias("after")) for i, x in enumerate(names)])
    marks = outside.select(key, "n", F.explode(marks).alias("m")).select(key, F.col("m.i").alias("i"), "m.below", "m.before", "m.after", (F.col("m.q") * (F.col("n") - 1)).alias("at"))
    hit = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: (v >= F.element_at("lo", i + 1)) & (v <= F.element_at("hi", i + 1)))
    inside = both.select(key, "v", F.explode(hit).alias("i")).groupBy(key, "i", "v").agg(F.count("*").alias("c"))
    upto = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(key, "i").orderBy("v")))
    ranked = upto.join(stored(marks, "marks"), [key, "i"])
    rank = lambda r: F.min(F.when(F.col("below") + F.col("upto") > r, v))
    lower, upper = F.floor("at"), F.ceil("at")
    found = ranked.groupBy(key, "i", "at").agg(
        F.when(F.min("below") > F.min(lower), F.min("before")).otherwise(F.coalesce(rank(lower), F.min("after"))).alias("a"),
        F.when(F.min("below") > F.min(upper), F.min("before")).otherwise(F.coalesce(rank(upper), F.min("after"))).alias("b"),
    )
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("i") == i, value_at)).alias(x) for i, x in enumerate(names)])


BINS = "metric int, bin int, value double, n long, lo double, hi double"


def binned(rows: DataFrame, cuts: list[np.ndarray], listed: list[list[int]]) -> DataFrame:
    """Of columns of doubles (see BINS): for each column and bin n, lo and hi of its values, where value is null, and for the
    listed bins each value with its n. Bin 2i + 1 is the i-th cut itself, bin 2i what lies under it and over the one before. Nulls
    are left out, NaN is the greatest. A task adds up its bins and holds one batch."""

    def run(batches):
        n = [np.zeros(2 * len(c) + 1, np.int64) for c in cuts]
        ends = [[None] * (2 * len(c) + 1) for c in cuts]
        for b in batches:
            for m, c in enumerate(cuts):
                v = np.sort(b.column(m).drop_null().to_numpy(zero_copy_only=False))
                at = np.stack([np.searchsorted(v, c, side) for side in ("left", "right")], 1).ravel()
                at = np.concatenate([[0], at, [len(v)]])
                n[m] += np.diff(at)
                for k in np.flatnonzero(np.diff(at)):
                    part, old = v[at[k] : at[k + 1]], ends[m][k]
                    ends[m][k] = np.sort([part[0], part[-1], *(old or ())])[[0, -1]].tolist()
                    if k in listed[m]:
                        new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                        fixed = [pa.array(np.full(len(new), x, np.int32)) for x in (m, k)]
                        none = pa.nulls(len(new), pa.float64())
                        yield pa.RecordBatch.from_arrays([*fixed, pa.array(part[new]), pa.array(np.diff(np.append(new, len(part)))), none, none], names)
        out = [(m, k, None, int(n[m][k]), *e) for m, es in enumerate(ends) for k, e in enumerate(es) if e]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64()))], names)

    names = [c.split()[0] for c in BINS.split(", ")]
    return rows.mapInArrow(run, BINS).groupBy("metric", "bin", "value").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def tallied(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the sums of their n; NaN is one value, the greatest."""
    distinct, at = np.unique(values, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, n)
    return distinct, sums


def few_values(rows: DataFrame, most: int = 2048) -> tuple[list[tuple[np.ndarray, np.ndarray] | None], int]:
    """Of each column of doubles, in order, its sorted distinct values and how often each occurs, or None for a column of more than
    `most`; and the number of rows. One pass, in which a task counts a column until it has met more than `most` values there, so what
    leaves a task and what comes to the driver is at most `most` + 1 values a column. Nulls are left out."""

    def run(batches):
        held: list = [[] for _ in rows_of]
        size, total = [0] * len(held), 0
        for b in batches:
            total += b.num_rows
            for m in range(len(held)):
                if held[m] is None:
                    continue
                seen = b.column(m).drop_null().value_counts()
                held[m].append((seen.field(0).to_numpy(zero_copy_only=False), seen.field(1).to_numpy(zero_copy_only=False)))
                size[m] += len(seen)
                if size[m] > 8 * most or len(seen) > most:
                    held[m] = [tallied(*map(np.concatenate, zip(*held[m])))]
                    size[m] = len(held[m][0][0])
                    held[m] = None if size[m] > most else held[m]
        out = [(np.array([-1]), [0.0], np.array([total]))]
        for m, parts in enumerate(held):
            if parts:
                values, n = tallied(*map(np.concatenate, zip(*parts)))
                parts = None if len(values) > most else [(np.full(len(values), m), values, n)]
            out += [(np.array([m]), [None], np.array([0]))] if parts is None else parts
        for metric, value, n in out:
            yield pa.RecordBatch.from_arrays([pa.array(metric, pa.int32()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], ["metric", "value", "n"])

    rows_of = rows.columns
    counts = rows.mapInArrow(run, "metric int, value double, n long").groupBy("metric", "value").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.asc_nulls_first("value")))
    found: dict[int, list] = {m: [] for m in range(-1, len(rows_of))}
    for r in counts.withColumn("place", place).filter(F.col("place") <= most + 1).collect():  # a null value: a task met too many
        found[r.metric].append((r.value, r.n))
    total = sum(n for _, n in found.pop(-1))
    few = lambda f: len(f) <= most and all(v is not None for v, _ in f)
    return [tallied(np.array([v for v, _ in f], float), np.array([n for _, n in f], np.int64)) if few(f) else None for f in found.values()], total


def counted_percentiles(values: np.ndarray, n: np.ndarray, points: dict) -> dict:
    """point -> exact percentile, linear between neighbours (None without values), of sorted values that occur n times."""
    if not len(values):
        return dict.fromkeys(points)
    ends = np.cumsum(n)
    out = {}
    for name, q in points.items():
        at = q * (int(ends[-1]) - 1)
        a, b = (float(values[np.searchsorted(ends, rank, "right")]) for rank in (math.floor(at), math.ceil(at)))
        out[name] = a if a == b else a + (b - a) * (at - math.floor(at))
    return out


def wide_percentiles(rows: DataFrame, points: dict, size: int = 8192, eps: float = 1e-3, *more: Column) -> tuple[list[dict], dict]:
    """Of each column of doubles, in order, a dict of points (name -> exact percentile, linear between neighbours, None without
    values), and the row of the aggregates `more`. Two passes over the rows as they are, however many columns: the first gives a
    KLL sketch of each column, which brackets the points within `eps` of their share, the second counts what lies
    between the brackets' ends and lists the values inside. A bracket that missed costs one more pass. Only borders and counts of bins,
    at most twenty or so numbers a point, come to the driver."""
    names = rows.columns
    shares = F.array(*[F.lit(min(1.0, max(0.0, q + d))) for q in points.values() for d in (-eps, eps)])
    sketches = [F.kll_sketch_agg_double(c, F.lit(size)).alias(f"sketch{i}") for i, c in enumerate(names)]
    row = rows.agg(*sketches, *more)
    cut_at = lambda i: F.when(F.kll_sketch_get_n_double(f"sketch{i}") > 0, F.kll_sketch_get_quantile_double(f"sketch{i}", shares)).alias(f"cuts{i}")
    row = stored(row, "sketches").select(*[cut_at(i) for i in range(len(names))], *row.columns[len(names) :]).first().asDict()
    found = [row.pop(f"cuts{i}") or [] for i in range(len(names))]
    cuts = [np.unique(np.array(f, float)) for f in found]
    listed = [sorted({k for lo, hi in zip(f[::2], f[1::2]) for k in range(2 * int(np.searchsorted(c, lo)) + 2, 2 * int(np.searchsorted(c, hi)) + 1, 2)}) for f, c in zip(found, cuts)]
    bins = stored(binned(rows, cuts, listed), "percentile-bins")
    held: list[list] = [[] for _ in names]
    for r in bins.filter("value is null and lo is not null").collect():  # at most a row per column and bin
        held[r.metric].append((r.bin, r.n, r.lo, r.hi))
    known, wanted, ranks = {}, set(), []
    for m, each in enumerate(held):
        each.sort()
        ends = np.cumsum([b[1] for b in each])
        for name, q in points.items() if each else ():
            at = q * (int(ends[-1]) - 1)
            for end, rank in enumerate((math.floor(at), math.ceil(at))):
                i = int(np.searchsorted(ends, rank, "right"))
                k, n, lo, hi = each[i]
                place = int(rank - (ends[i] - n))
                ranks.append((m, name, end, at - math.floor(at), (m, k, place)))
                if lo == hi or place in (0, n - 1):
                    known[m, k, place] = lo if place == 0 else hi
                else:
                    wanted.add((m, k, place))
    missed = [sorted({k for mm, k, _ in wanted if mm == m and k not in listed[m]}) for m in range(len(names))]
    values = bins.filter("lo is null")
    if any(missed):
        values = values.unionByName(binned(rows, cuts, missed).filter("lo is null"))
    if wanted:
        places = values.sparkSession.createDataFrame(sorted(wanted), "metric int, bin int, place long")  # two rows a point and column at most
        inside = values.join(F.broadcast(places.select("metric", "bin").distinct()), ["metric", "bin"])
        upto = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("metric", "bin").orderBy("value")))
        at = upto.join(F.broadcast(places), ["metric", "bin"]).groupBy("metric", "bin", "place").agg(F.min(F.when(F.col("upto") > F.col("place"), F.col("value"))).alias("v"))
        known |= {(r.metric, r.bin, r.place): r.v for r in at.collect()}
    out: list[dict] = [dict.fromkeys(points) for _ in names]
    for m, name, end, share, key in ranks:
        out[m][name] = known[key] if end == 0 else out[m][name] + (known[key] - out[m][name]) * share
    return out, row
