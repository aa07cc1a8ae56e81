"""Nearest neighbours and ball cover of vectors by a metric join.

A bounded sample gives pivots that lie far from each other. Every row belongs to the cell of its nearest pivot; cells
are cut into rings by the distance to the pivot, and rings into blocks of a bounded number of rows, each one packed row.
From a block's cell and ring the triangle inequality gives the least distance that any of its rows can have to
a row of another block, and to a single row also half-way planes between pivots. A block meets only those blocks
that may hold something nearer than what is known already: for neighbours, the largest k-th distance inside the block
itself; for balls, the largest radius of the block of balls. Which they are is found from the blocks' borders,
cell by cell, so no list of all pairs of rows is made. Blocks that lie near each other form groups, a task each, and what any of a
group's blocks is to meet comes to the group once, so what moves is the table times the number of groups. That number stays
the same until a group would hold too much for a task. The others come to a group nearest first, its rows' bounds
shrink as they come, and rows that a block cannot serve any more sit it out.

Distances that decide are sums of squared differences, the same whichever side asks; products only choose which to compute.

Nulls: rows with a null item, or whose vector is null or holds nulls or non-finite numbers, take no part. All vectors
have one length. An item meets no row of its own id. An empty side has no neighbours and covers nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

BLOCK = "block long, cell int, lo double, hi double, n int, items binary, x binary"
BALLS = f"{BLOCK}, radii binary, reach array<double>, seen long"
#: Rounding that bounds allow for, as a part of the distances that they are made of.
SLACK = 1e-9
#: Groups of blocks: so many where there are as many blocks, and more where the vectors of one would exceed so many bytes.
GROUPS, GROUP_BYTES = 24, 32 << 20


def usable(rows: DataFrame) -> DataFrame:
    """(item long, x array<double>)."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.select(F.col("item").cast("long").alias("item"), F.col("x").cast("array<double>").alias("x")).filter(F.col("item").isNotNull() & (F.size("x") > 0) & finite)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances, near enough to choose by."""
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(sq, 0))


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows, one to one."""
    return np.sqrt(((x - y) ** 2).sum(1))


def pivots_of(rows: DataFrame, most: int) -> np.ndarray:
    """Up to `most` vectors far from each other, out of a sample of eight times as many."""
    sample = rows.orderBy(F.xxhash64("item"), "item").limit(8 * most).select("x").collect()
    if not sample:
        return np.zeros((0, 0))
    x = np.array([r.x for r in sample], np.float64)
    taken = [0]
    gap = products(x, x[:1])[:, 0]
    while len(taken) < most and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, products(x, x[taken[-1:]])[:, 0])
    return x[taken]


@dataclass
class Cells:
    """What is known of the cells of one table: as many numbers as there are pivots."""

    pivots: np.ndarray
    between: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    blocks: np.ndarray
    repeats: int  # the most rows of one id


def blocks_of(rows: DataFrame, pivots: np.ndarray, block_rows: int, rings: int = 16) -> tuple[DataFrame, Cells]:
    """A packed row per block (see BLOCK), stored. Vectors that are singles go as singles."""

    def assign(frames):
        for f in frames:
            for lo in range(0, len(f), 4096):
                part = f.iloc[lo : lo + 4096]
                x = np.stack(part["x"].to_numpy()).astype(np.float64)
                cell = products(x, pivots).argmin(1)
                yield pd.DataFrame({"item": part["item"], "x": part["x"], "cell": cell.astype(np.int32), "gap": gaps(x, pivots[cell])})

    placed = rows.mapInPandas(assign, "item long, x array<double>, cell int, gap double")
    placed = stored(placed, "metric-cells")
    shares = F.array(*[F.lit(i / rings) for i in range(1, rings)])
    # One row per pivot, and at most `rings` more for each: bounded by the parameters, so they are broadcast.
    edges = placed.groupBy("cell").agg(F.percentile_approx("gap", shares, 1000).alias("edges"), F.least(F.lit(rings), F.ceil(F.count("*") / block_rows)).alias("rings"))
    ring = F.floor(F.size(F.filter("edges", lambda e: e < F.col("gap"))) * F.col("rings") / rings).cast("int")
    ringed = placed.join(F.broadcast(edges), "cell").withColumn("ring", ring).drop("edges", "rings")
    parts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    dealt = ringed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        block = (int(key[0]) << 44) + (int(key[1]) << 36) + int(key[2])
        x = np.stack(f["x"].to_numpy()).astype(np.float64)
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        x = short if (short == x).all() else x
        return pd.DataFrame([{"block": block, "cell": key[0], "lo": f["gap"].min(), "hi": f["gap"].max(), "n": len(f), "items": f["item"].to_numpy(np.int64).tobytes(), "x": x.tobytes()}])

    blocks = stored(dealt.groupBy("cell", "ring", "part").applyInPandas(pack, BLOCK), "metric-blocks")
    between = np.stack([gaps(pivots, p) for p in pivots])
    cells = Cells(pivots, between, np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), placed.groupBy("item").count().agg(F.max("count")).first()[0] or 0)
    for r in blocks.groupBy("cell").agg(F.min("lo"), F.max("hi"), F.sum("n"), F.count("*")).collect():  # a row per pivot
        cells.lo[r[0]], cells.hi[r[0]], cells.n[r[0]], cells.blocks[r[0]] = r[1], r[2], r[3], r[4]
    return blocks, cells


def least_gap(between, lo, hi, other_lo, other_hi):
    """Lower bound of distances between a ring around one pivot and a ring around another."""
    return np.maximum.reduce([between - hi - other_hi, other_lo - between - hi, lo - between - other_hi, np.zeros(np.broadcast(between, lo, other_lo).shape)])


class Rows:
    """The rows of one packed block."""

    def __init__(self, row: dict, dims: int):
        self.items = np.frombuffer(row["items"], np.int64)
        single = len(row["x"]) == 4 * dims * len(self.items)
        self.x = np.frombuffer(row["x"], np.float32 if single else np.float64).reshape(-1, dims).astype(np.float64, copy=False)
        self.cell, self.lo, self.hi = row["cell"], row["lo"], row["hi"]


def row_bounds(own: Rows, home: np.ndarray, other: Rows, cells: Cells) -> np.ndarray:
    """Lower bound of each row's distance to any row of another block. home: the rows' distances to their own pivot."""
    gap = gaps(own.x, cells.pivots[other.cell])
    out = np.maximum(np.maximum(gap - other.hi, other.lo - gap), 0)
    apart = cells.between[own.cell, other.cell]
    if apart > 1e-6 * gap.max():  # else the half-way plane is lost in rounding
        out = np.maximum(out, (gap**2 - home**2) / (2 * apart))
    return out - SLACK * (gap + other.hi)


def scale(x: np.ndarray) -> np.ndarray:
    """How far products() can be off, times 1e-6 or less."""
    return np.sqrt((x * x).sum(1))


class Nearest:
    """Distances of a block's rows to the `most` nearest so far."""

    def __init__(self, own: Rows, cells: Cells, most: int):
        self.own, self.cells, self.most = own, cells, most
        self.home = gaps(own.x, cells.pivots[own.cell])
        self.best = np.full((len(own.x), most), np.inf)
        self.seen = 0

    def meet(self, other: Rows, step: int = 256) -> None:
        live = np.flatnonzero(row_bounds(self.own, self.home, other, self.cells) <= self.best[:, -1])
        self.seen += len(live) * len(other.x)
        for lo in range(0, len(live), step):
            at = live[lo : lo + step]
            g = products(self.own.x[at], other.x)
            g[self.own.items[at][:, None] == other.items[None]] = np.inf
            wide = min(self.most, g.shape[1])
            kth = np.partition(g, wide - 1, axis=1)[:, wide - 1]
            limit = np.minimum(kth, self.best[at, -1]) + 1e-6 * (scale(self.own.x[at]) + scale(other.x).max())
            r, c = np.nonzero((g <= limit[:, None]) & np.isfinite(g))
            exact = gaps(self.own.x[at[r]], other.x[c])
            order = np.lexsort((exact, r))
            r, exact = r[order], exact[order]
            slot = np.arange(len(r)) - np.searchsorted(r, r)
            keep = slot < self.most
            new = np.full((len(at), self.most), np.inf)
            new[r[keep], slot[keep]] = exact[keep]
            self.best[at] = np.sort(np.concatenate([self.best[at], new], 1), axis=1)[:, : self.most]


def block_pairs(asking: DataFrame, asked: DataFrame, cells: Cells, asked_cells: Cells, reach: np.ndarray | None = None) -> DataFrame:
    """(block, other, least): blocks that may hold a row within the distance that counts, which is `reach` of the
    asking block or, where `reach` is given (of each asked cell), that of the asked block."""

    def candidates(frames):
        for f in frames:
            for lo in range(0, len(f), 1024):
                part = f.iloc[lo : lo + 1024]
                cell = part["cell"].to_numpy()
                bound = least_gap(cells.between[cell], part["lo"].to_numpy()[:, None], part["hi"].to_numpy()[:, None], asked_cells.lo[None], asked_cells.hi[None])
                far = reach[None] if reach is not None else part["reach"].to_numpy()[:, None]
                i, j = np.nonzero((bound - SLACK * (cells.between[cell] + asked_cells.hi) <= far) & (asked_cells.n > 0))
                yield pd.DataFrame({"block": part["block"].to_numpy()[i], "lo": part["lo"].to_numpy()[i], "hi": part["hi"].to_numpy()[i], "reach": part["reach"].to_numpy()[i], "between": cells.between[cell[i], j], "to_cell": j.astype(np.int32)})

    borders = asking.select("block", "cell", "lo", "hi", "reach" if reach is None else F.lit(0.0).alias("reach"))
    wanted = borders.mapInPandas(candidates, "block long, lo double, hi double, reach double, between double, to_cell int")
    others = asked.select(F.col("block").alias("other"), F.col("cell").alias("to_cell"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), *([] if reach is None else [F.col("reach").alias("other_reach")]))
    c = F.col
    least = F.greatest(c("between") - c("hi") - c("other_hi"), c("other_lo") - c("between") - c("hi"), c("lo") - c("between") - c("other_hi"), F.lit(0.0))
    far = c("reach") if reach is None else c("other_reach")
    return wanted.join(others, "to_cell").withColumn("least", least).filter(c("least") - SLACK * (c("between") + c("other_hi")) <= far).select("block", "other", "least")


def groups_of(blocks: DataFrame, cells: Cells) -> tuple[DataFrame, int]:
    """(block, at): the group of each block, cells in order and each cell's blocks in order; and how many groups there are."""
    total, size = int(cells.blocks.sum()), int(cells.n.sum()) * cells.pivots.shape[1] * 8
    n = max(1, min(total, max(GROUPS, -(-size // GROUP_BYTES))))
    before = F.array(*[F.lit(int(k)) for k in np.cumsum(cells.blocks) - cells.blocks])
    nth = F.element_at(before, F.col("cell") + 1) + F.row_number().over(Window.partitionBy("cell").orderBy("block")) - 1
    return blocks.select("block", F.floor(nth * n / max(1, total)).cast("int").alias("at")), n


def visits(asking: DataFrame, asked: DataFrame, pairs: DataFrame, fields: list[str], cells: Cells) -> DataFrame:
    """A partition per group of asking blocks: the rows of its blocks (least -1), then, once each, those that any of them meets
    (whom), the nearest first. cells: of the asking side."""
    groups, n = groups_of(asking, cells)
    groups = stored(groups, "metric-groups")
    own = asking.join(groups, "block").select("at", F.lit(-1.0).alias("least"), F.array("block").alias("whom"), *[F.col(f) if f in asking.columns else F.lit(None).cast(asked.schema[f].dataType).alias(f) for f in fields])
    wanted = pairs.join(groups, "block").groupBy("at", F.col("other").alias("block")).agg(F.min("least").alias("least"), F.sort_array(F.collect_list("block")).alias("whom"))
    come = asked.join(stored(wanted, "metric-visits"), "block").select("at", "least", "whom", *fields)
    return own.unionByName(come).repartitionById(n, F.col("at")).sortWithinPartitions("least", "block")


def led(batches, fields: list[str]):
    """The rows of Arrow batches as dicts."""
    for b in batches:
        for i in range(b.num_rows):
            yield {f: b.column(f)[i].as_py() for f in fields}


def with_radii(blocks: DataFrame, cells: Cells, ks: tuple) -> DataFrame:
    """Blocks with each row's distances to its k-th nearest other items (inf where there are fewer), the largest of each,
    and how many distances were computed (see BALLS), stored."""
    most, dims = max(ks), cells.pivots.shape[1]
    order = np.argsort(cells.between + cells.hi[None], axis=1)
    # From the borders alone: all rows of a cell have `most` rows of other ids within this distance.
    upto = np.cumsum(cells.n[order], axis=1) >= most + cells.repeats
    outer = np.take_along_axis(cells.between + cells.hi[None], order, 1)
    surely = np.where(upto.any(1), outer[np.arange(len(order)), upto.argmax(1)], np.inf) + np.maximum(cells.hi, 0)

    def inside(batches):
        for row in led(batches, ["block", "cell", "lo", "hi", "items", "x"]):
            own = Rows(row, dims)
            found = Nearest(own, cells, most)
            found.meet(own)
            far = min(float(found.best[:, -1].max()), float(surely[own.cell]))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["cell"]], pa.int32()), *[pa.array([v], pa.float64()) for v in (row["lo"], row["hi"], far)]], ["block", "cell", "lo", "hi", "reach"])

    borders = stored(blocks.mapInArrow(inside, "block long, cell int, lo double, hi double, reach double"), "metric-reach")
    pairs = stored(block_pairs(borders, blocks, cells, cells), "metric-pairs")
    fields = ["block", "cell", "lo", "hi", "n", "items", "x"]

    def done(row: dict, found: Nearest) -> pa.RecordBatch:
        radii = np.ascontiguousarray(found.best[:, [k - 1 for k in ks]])
        held = np.where(np.isfinite(radii), radii, -1.0)
        out = {**row, "radii": held.tobytes(), "reach": held.max(0).tolist(), "seen": found.seen + len(found.own.x) ** 2}  # and the pass inside the block
        return pa.RecordBatch.from_arrays([pa.array([out[f]], t) for f, t in zip(names, types)], names)

    names = [c.split()[0] for c in BALLS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.int64()]

    def run(batches):
        held = {}
        for r in led(batches, ["least", "whom", *fields]):
            other = Rows(r, dims)
            if r["least"] < 0:
                held[r["block"]] = {f: r[f] for f in fields}, Nearest(other, cells, most)
                continue
            for block in r["whom"]:
                held[block][1].meet(other)
        for row, found in held.values():
            yield done(row, found)

    return stored(visits(blocks, blocks, pairs, fields, cells).mapInArrow(run, BALLS), "metric-balls")


def covered(points: DataFrame, cells: Cells, balls: DataFrame, ball_cells: Cells, ks: tuple) -> DataFrame:
    """(k, n, seen): how many rows of the points' blocks lie inside a ball of radius k of any row of `balls`, and how many
    distances were computed."""
    dims, top = cells.pivots.shape[1], len(ks)
    far = np.full(len(cells.pivots), -1.0)
    for cell, most in balls.groupBy("cell").agg(F.max(F.array_max("reach"))).collect():  # a row per pivot
        far[cell] = most
    asked = balls.withColumn("reaches", F.col("reach")).withColumn("reach", F.array_max("reach"))
    pairs = stored(block_pairs(points, asked, cells, ball_cells, far), "metric-cover")
    fields = ["block", "cell", "lo", "hi", "items", "x", "radii", "reaches"]

    def run(batches):
        held, seen = {}, 0
        for r in led(batches, ["least", "whom", *fields]):
            other = Rows(r, dims)
            if r["least"] < 0:
                held[r["block"]] = other, np.zeros((len(other.x), top), bool), gaps(other.x, cells.pivots[other.cell])
                continue
            radii, reaches = np.frombuffer(r["radii"], np.float64).reshape(-1, top), np.array(r["reaches"])
            for block in r["whom"]:
                own, got, home = held[block]
                wanted = np.where(got, -1.0, reaches[None]).max(1)  # largest radius that may still tell a point something
                live = np.flatnonzero((row_bounds(own, home, other, cells) <= wanted) & (wanted >= 0))
                seen += len(live) * len(other.x)
                for lo in range(0, len(live), 256):
                    at = live[lo : lo + 256]
                    g = products(own.x[at], other.x)
                    p, b = np.nonzero(g <= radii.max(1)[None] + 1e-6 * (scale(own.x[at])[:, None] + scale(other.x)[None]))
                    np.logical_or.at(got, at[p], gaps(own.x[at[p]], other.x[b])[:, None] <= radii[b])
        total = sum((got.sum(0) for _, got, _ in held.values()), np.zeros(top, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(total), pa.array([seen] + [0] * (top - 1))], ["k", "n", "seen"])

    return visits(points, asked, pairs, fields, cells).mapInArrow(run, "k int, n long, seen long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def precision_recall(real: DataFrame, made: DataFrame, ks: tuple = (1, 3, 5, 11, 21), pivots: int = 128, block_rows: int = 1024) -> DataFrame:
    """k, precision, recall, pairs: the share of each side inside the k-nearest-neighbour balls of the other over all rows,
    and how many distances all of it took (the same number in each row)."""
    spark, ks = real.sparkSession, tuple(sorted(ks))
    real, made = usable(real), usable(made)
    sides, shares, seen = {}, {}, 0
    counts = {"real": real.count(), "made": made.count()}
    centres = pivots_of(real.union(made), min(pivots, -(-4 * max(counts.values()) // block_rows)) or 1)
    if len(centres):
        for name, rows in (("real", real), ("made", made)):
            blocks, cells = blocks_of(rows, centres, block_rows)
            balls = with_radii(blocks, cells, ks)
            sides[name] = blocks, cells, balls
            seen += balls.agg(F.sum("seen")).first()[0] or 0
        for name, points, around in (("precision", "made", "real"), ("recall", "real", "made")):
            found = covered(*sides[points][:2], sides[around][2], sides[around][1], ks).collect() if counts["real"] and counts["made"] else []  # a row per k
            shares[name] = {r.k: r.n / counts[points] for r in found}
            seen += sum(r.seen for r in found)
    rows = [(k, shares.get("precision", {}).get(k, 0.0), shares.get("recall", {}).get(k, 0.0), int(seen)) for k in ks]
    return spark.createDataFrame(rows, "k int, precision double, recall double, pairs long").select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "pairs")
