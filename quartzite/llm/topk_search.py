"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are whole numbers, so scores are exact. Candidates are dealt into shards by descending length, one
series of shards per number of components. All queries first meet the shard of the longest vectors, which
gives each of them a threshold. A block of queries is then sent, with a copy of the shard, only to shards
whose longest vector could still beat the threshold of one of its queries (|q||x| >= threshold), and of the
block only the queries that need the shard. Inside a shard, blocks come by descending length, the first one small,
so that there is a threshold early. Coordinates are rotated by the shard's own singular vectors and multiplied in
steps, the strongest first; after each step the rest is bounded by the product of the residual lengths, and queries
and candidates of which no pair can reach the threshold any more take no further step. Of the pairs that are left
each query's k most promising are scored, which raises its threshold, and then only those that still
reach it. No block is multiplied out.

Bounds carry a slack relative to |q||x|, far above their rounding error, so nothing that could win is pruned.
Scores from 2^53 on are summed in integers of any size; beyond the range of a long they count as its end.

Nulls: rows with a null id or a vector that is null, empty, or holds nulls or non-finite numbers take no
part. Vectors of other lengths than the query's have no inner product with it and are no candidates of it.
Equal rows count once; ties in score go to the smaller vec_id. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, usable_vectors

OUT = "query_id long, vec_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1
EXACT = 2.0**53


def lengths_of(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow in between."""
    top = np.maximum(np.abs(x).max(1, initial=0), 1e-300)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def rotation_of(c: np.ndarray, shares: tuple = (0.35, 0.6, 0.8, 0.92)) -> tuple[np.ndarray, list[int]]:
    """The right singular vectors of c, strongest first, and how many of them hold each share of the energy, in
    steps of four."""
    scale = max(1.0, np.abs(c).max(initial=0))
    energy, basis = np.linalg.eigh((c / scale).T @ (c / scale))
    energy = energy[::-1].clip(0)
    at = np.searchsorted(np.cumsum(energy), np.array(shares) * energy.sum()) + 1
    return basis[:, ::-1].copy(), sorted({int(min(c.shape[1], -(-h // 4) * 4)) for h in at})


def whole_products(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and c, pair by pair; bound: the product of their lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        floats = np.rint(np.einsum("ij,ij->i", q, c))
    large = ~(bound < EXACT)
    out = np.where(large, 0, floats).astype(np.int64)
    for i in np.flatnonzero(large):
        out[i] = max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(q[i], c[i]))))
    return out


def k_best(row, score, ids, k: int):
    """The k first of each row by descending score, then id; also each row's last kept score and whether it
    has k of them."""
    order = np.lexsort((ids, ~score, row))  # ~score falls as score rises, and cannot overflow
    row, score, ids = row[order], score[order], ids[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], ids[keep]


def scan_shard(q_id, q, floor, c_id, c, k, block=1024, rows=1024, turn=None, tally=None):
    """Top-k of each query in one shard: (query position, candidate id, score) arrays. q and c hold whole
    numbers; floor: the score that a candidate has to reach, as whole numbers, LEAST if none is known. turn: (rotation,
    cuts), by default the shard's own. tally: a list that gets the number of pairs scored in each block."""
    length = lengths_of(c)
    order = np.lexsort((c_id, -length))
    c, c_id, length = c[order], c_id[order], length[order]
    rotation, cuts = turn or rotation_of(c)
    slack = 1e-12 * (c.shape[1] + 8)
    with np.errstate(over="ignore", invalid="ignore"):
        c_rot = c @ rotation
    rest_of = lambda x: [lengths_of(x[:, h:]) if h < x.shape[1] else np.zeros(len(x)) for h in cuts]
    c_rest = rest_of(c_rot)
    starts = [0, *range(min(len(c), max(4 * k, block // 16)), len(c), block)]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for a in range(0, len(q), rows):
        qs, ids, least = q[a : a + rows], q_id[a : a + rows], floor[a : a + rows].copy()
        with np.errstate(over="ignore", invalid="ignore"):
            q_rot, q_len = qs @ rotation, lengths_of(qs)
        q_rest = rest_of(q_rot)
        held = (np.empty(0, np.int64),) * 3
        bar = np.where(least == LEAST, -np.inf, least.astype(np.float64))

        def take(row, col):
            """Score pairs, and raise the thresholds of their queries."""
            nonlocal held, bar
            for lo in range(0, len(row), 1 << 18):
                r, j = row[lo : lo + (1 << 18)], col[lo : lo + (1 << 18)]
                with np.errstate(over="ignore"):
                    most = q_len[r] * length[j]
                score = whole_products(qs[r], c[j], most)
                good = score >= least[r]
                if not good.any():
                    continue
                held = k_best(*(np.concatenate([x, y]) for x, y in zip(held, (r[good], score[good], c_id[j][good]))), k)
                full = np.bincount(held[0], minlength=len(qs)) >= k
                last = np.searchsorted(held[0], np.flatnonzero(full), side="right") - 1
                least[full] = np.maximum(least[full], held[1][last])
                bar = np.where(least == LEAST, -np.inf, least.astype(np.float64))

        for lo, hi in zip(starts, [*starts[1:], len(c)]):
            if lo == hi:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                live = np.flatnonzero(~(q_len * length[lo] * (1 + slack) < bar))  # longest first: no later block helps the others
                if not len(live):
                    break
                cols, done = np.arange(lo, hi), 0
                part = np.zeros((len(live), len(cols)))
                for i, cut in enumerate(cuts):
                    part = part + q_rot[live, done:cut] @ c_rot[cols, done:cut].T
                    bound = part + np.outer(q_rest[i][live], c_rest[i][cols]) + slack * np.outer(q_len[live], length[cols])
                    may = ~(bound < bar[live, None]) & (ids[live, None] != c_id[None, cols])
                    on, off = may.any(1), may.any(0)
                    if not (on.all() and off.all()):
                        live, cols = live[on], cols[off]
                        part, bound, may = part[on][:, off], bound[on][:, off], may[on][:, off]
                    done = cut
                    if not len(live):
                        break
            if not len(live):
                continue
            hope = np.where(may, bound, -np.inf)
            first = np.zeros(may.shape, bool)
            if len(cols) > k:
                np.put_along_axis(first, np.argpartition(hope, len(cols) - k, axis=1)[:, len(cols) - k :], True, 1)
            r, j = np.nonzero(may & first)
            take(live[r], cols[j])
            again = may & ~first & ~(bound < bar[live, None])
            r2, j2 = np.nonzero(again)
            take(live[r2], cols[j2])
            if tally is not None:
                tally.append(len(r) + len(r2))
        out.append((held[0] + a, held[2], held[1]))
    return tuple(np.concatenate(x) for x in zip(*out))


def length(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 16384, query_rows: int = 8192, block: int = 1024) -> DataFrame:
    """vectors, queries: (vec_id long, vec array<double>) of whole numbers. Returns query_id, rank,
    vec_id, score: the k largest inner products of each query over all vectors but those with its id.

    What moves: each query once per shard that it needs, and each shard once per block of query_rows queries
    that need it."""
    vectors = settled(vectors, "topk-vectors")
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumns({"d": F.size("vec"), "length": length("vec")})
    if shards > 1:
        dealt = dealt.repartitionByRange(shards, "d", F.desc("length"), F.xxhash64("vec_id"), F.xxhash64("vec"))
    dealt = settled(dealt.withColumn("shard", F.spark_partition_id()), "topk-shards")
    longest = settled(dealt.groupBy("d", "shard").agg(F.max("length").alias("longest")), "topk-longest")
    lead = longest.groupBy("d").agg(F.min("shard").alias("lead"))

    queries = settled(queries, "topk-asked")
    q_blocks = max(1, -(-queries.count() // query_rows))
    number = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(q_blocks)).cast("int")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"), F.size("vec").alias("d"), number.alias("q_block"), length("vec").alias("q_length"))

    def scan(_: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q_id, c_id = q.query_id.to_numpy(np.int64), c.vec_id.to_numpy(np.int64)
        at, ids, score = scan_shard(q_id, np.stack(q.q.to_numpy()).astype(np.float64), q.floor.to_numpy(np.int64), c_id, np.stack(c.vec.to_numpy()).astype(np.float64), k, block)
        return pd.DataFrame({"query_id": q_id[at], "vec_id": ids, "score": score})

    def visited(visits: DataFrame, pairs: DataFrame) -> DataFrame:
        """visits: queries with d, shard, q_block; pairs: the (d, shard, q_block) among them."""
        copies = dealt.join(pairs, ["d", "shard"]).select(*[F.col(c).alias(c) for c in ("vec_id", "vec", "d", "shard", "q_block")])
        keys = ["d", "shard", "q_block"]
        return visits.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(scan, OUT)

    first_pairs = lead.withColumnRenamed("lead", "shard").join(asked.select("d", "q_block").distinct(), "d")
    first = settled(visited(asked.join(lead.withColumnRenamed("lead", "shard"), "d").withColumn("floor", F.lit(LEAST)), first_pairs), "topk-first")
    found = first
    if shards > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LEAST)).alias("floor"))
        known = settled(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))), "topk-queries")
        reach = F.when((F.col("q_length") > 0) & (F.col("floor") != LEAST), F.col("floor") / F.col("q_length")).otherwise(F.lit(float("-inf")))
        blocks = known.groupBy("d", "q_block").agg(F.min(reach).alias("reach"))
        room = F.lit(1 + 1e-9)
        pairs = blocks.join(longest.join(lead, "d").filter("shard != lead"), "d").filter(F.col("longest") * room + F.abs("reach") * 1e-9 >= F.col("reach"))
        pairs = settled(pairs.select("d", "shard", "q_block", "longest"), "topk-pairs")
        needs = (F.col("q_length") * F.col("longest") * room >= F.col("floor")) | (F.col("floor") == LEAST)
        found = found.union(visited(known.join(pairs, ["d", "q_block"]).filter(needs).drop("longest", "q_length"), pairs.drop("longest")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """floor(scale * x) of each component, as whole doubles; a product beyond the doubles counts as their end."""
    rows = usable_vectors(df, id_col, vec_col)
    end = F.lit(np.finfo(np.float64).max.item())

    def whole(x: Column) -> Column:
        y = F.greatest(-end, F.least(end, x * F.lit(scale)))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return rows.withColumn("vec", F.transform("vec", whole)).dropDuplicates(["vec_id", "vec"])
