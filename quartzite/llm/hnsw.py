"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node with its smallest ids, as many as a result can hold, so copies cannot crowd a
neighbourhood and ties among them are exact. Nodes are dealt into shards that grow with the root of all rows up to a bound, apart by
number of components. Each shard becomes one row of an index table: its ids and vectors, and for each level
one flat array of neighbour positions, a fixed number per node. Largest inner product is turned into nearest
distance by one added coordinate, sqrt(longest² - |x|²).

Graphs grow by insertion. A node's top level is drawn at random; on each level down from there a beam search
from where the level above ended gives candidates, of which those are linked that are nearer to the node
than to any linked before (free places go to the nearest left out), and a neighbour that gets more links
than it has places is cut back by the same rule. Nodes come in growing batches, whose searches take their
steps together.

A search starts from all nodes of the top level and goes down level by level with a beam. Each query goes to every
shard of its number of components; the shards' best are merged, scored by the plain double inner product. What
moves: a query once per shard, and a shard once per block of query_rows queries, which stream past it.

Nulls: rows with a null id or a vector that is null, empty, all zero, or holds nulls or non-finite numbers
take no part. Equal rows count once; ties in score go to the smaller vec_id. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, usable_vectors

INDEX = "d int, shard int, n int, ids binary, id_counts binary, vectors binary, nodes array<binary>, links array<binary>"


def lifted(x: np.ndarray) -> np.ndarray:
    """One coordinate more, so that all have the same length and the nearest has the largest product."""
    x = x / max(np.abs(x).max(initial=0), 1e-300)
    sq = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]], 1).astype(np.float32)


def spread_out(x: np.ndarray, own: np.ndarray, near: np.ndarray, places: int) -> np.ndarray:
    """For each node of `own` up to `places` of its candidates `near` (n, width; -1 for none): nearest first,
    those nearer to the node than to all taken before, then the nearest left out. -1 where there are fewer."""
    sim = np.where(near >= 0, np.einsum("bd,bsd->bs", x[own], x[near]), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")
    near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
    v = x[near]
    among = v @ v.transpose(0, 2, 1)
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        clash = (kept[:, :j] & (among[:, :j, j] > sim[:, j, None])).any(1)
        kept[:, j] = ~clash & (near[:, j] >= 0) & (kept[:, :j].sum(1) < places)
    order = np.argsort(~kept, axis=1, kind="stable")[:, :places]
    out = np.full((len(own), places), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def link_back(x: np.ndarray, links: np.ndarray, own: np.ndarray, picked: np.ndarray) -> None:
    """Each picked neighbour gets a link to its node; where places run out, all are weighed anew (of very
    many, the nearest four times as many as there are places)."""
    to, who = picked.ravel(), np.repeat(own, picked.shape[1])
    who, to = who[to >= 0], to[to >= 0]
    order = np.lexsort((-np.einsum("bd,bd->b", x[to], x[who]), to))
    to, who = to[order], who[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    slot = np.arange(len(to)) - np.repeat(first, count)
    places = links.shape[1]
    width = min(int(count.max(initial=0)), 3 * places)
    come = np.full((len(nodes), width), -1, np.int32)
    fits = slot < width
    come[np.repeat(np.arange(len(nodes)), count)[fits], slot[fits]] = who[fits]
    both = np.concatenate([links[nodes], come], 1)
    both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    over = (both >= 0).sum(1) > places
    links[nodes[~over]] = both[~over, :places]
    for lo in range(0, int(over.sum()), 512):
        at = np.flatnonzero(over)[lo : lo + 512]
        links[nodes[at]] = spread_out(x, nodes[at], both[at], places)


def grow(x: np.ndarray, places: int, above: np.ndarray, start: np.ndarray, m: int, wide: int, batch: int = 768) -> np.ndarray:
    """Links (n, places) of one level, its nodes inserted in the order: those of `above`, then the rest. start:
    for each node positions from which its search sets out, -1 for none."""
    n = len(x)
    links = np.full((n, places), -1, np.int32)
    order = np.concatenate([above, np.setdiff1d(np.arange(n), above)])
    within = np.zeros(n, bool)
    seed = order[: min(n, 2 * wide)]  # the first few see all of each other
    if len(seed) > 1:
        near = np.broadcast_to(seed, (len(seed), len(seed))).copy()
        np.fill_diagonal(near, -1)
        links[seed] = spread_out(x, seed, near, places)
    within[seed] = True
    at = len(seed)
    while at < n:
        own = order[at : at + max(16, min(batch, at // 2))]
        begin = np.concatenate([np.where((start[own] >= 0) & within[start[own]], start[own], -1), np.full((len(own), 1), order[0])], 1)
        found, _ = beam(x[own], x, links, first_only(begin), wide, step=8)
        picked = spread_out(x, own, found.astype(np.int32), m)
        links[own, :m] = picked
        link_back(x, links, own, picked)
        within[own] = True
        at += len(own)
    return links


def build(x: np.ndarray, m: int = 16, wide: int = 48, ratio: int = 16) -> tuple[list, list]:
    """Positions of each level's nodes and their links (positions in the level), the lowest level first. A
    node is on level l with probability ratio^-l."""
    up = lifted(np.asarray(x, np.float64))
    top = np.floor(-np.log(1 - np.random.default_rng(len(x)).random(len(x))) / np.log(ratio)).astype(int)
    levels = [np.arange(len(x), dtype=np.int32)]
    while len(levels[-1]) > 4 * ratio:
        at = np.flatnonzero(top >= len(levels)).astype(np.int32)
        if not 0 < len(at) < len(levels[-1]):
            break
        levels.append(at)
    nodes, links = [], []
    for at in levels[::-1]:
        start = np.full((len(at), 1), -1, np.int64)
        above = np.zeros(0, np.int64)
        if nodes:
            above = np.searchsorted(at, nodes[0])
            found = np.concatenate([descend(up[at[lo : lo + 1024]], up, nodes, links, 8) for lo in range(0, len(at), 1024)])
            start = np.where(found >= 0, np.searchsorted(at, found), -1)
            own = np.arange(len(at))[:, None]
            start = np.where(start == own, -1, start)
        links.insert(0, grow(up[at], 2 * m, above, start, m, wide))
        nodes.insert(0, at)
    return nodes, links


def beam(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best ef positions and scores for each query (-1, -inf where fewer are reached)."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)
    rows = np.arange(b)[:, None]
    seen[rows, start] = True
    seen[:, n] = True
    score = np.where(start >= 0, np.einsum("bd,bsd->bs", q, x[start]), -np.inf)
    at, done = start.copy(), np.zeros(start.shape, bool)
    ef = max(ef, step)
    live = np.arange(b)
    if at.shape[1] < ef:
        pad = ef - at.shape[1]
        at = np.concatenate([at, np.full((b, pad), -1)], 1)
        score = np.concatenate([score, np.full((b, pad), -np.inf, score.dtype)], 1)
        done = np.concatenate([done, np.ones((b, pad), bool)], 1)
    else:
        keep = np.argpartition(-score, ef - 1, axis=1)[:, :ef]
        at, score, done = (np.take_along_axis(a, keep, 1) for a in (at, score, done))
    while len(live):
        a, s, f = at[live], score[live], done[live]
        open_score = np.where(f | (a < 0), -np.inf, s)
        pick = np.argpartition(-open_score, step - 1, axis=1)[:, :step]
        usable = np.take_along_axis(open_score, pick, 1) > -np.inf
        going = usable.any(1)
        if not going.all():
            live, a, s, f, pick, usable = live[going], a[going], s[going], f[going], pick[going], usable[going]
            if not len(live):
                break
        np.put_along_axis(f, pick, True, 1)
        chosen = np.where(usable, np.take_along_axis(a, pick, 1), n)
        near = np.where((chosen < n)[:, :, None], links[np.minimum(chosen, n - 1)], -1).reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[live[:, None], near], n, near)
        seen[live[:, None], near] = True
        width = int((near < n).sum(1).max(initial=0))
        if width:
            near = np.sort(near, axis=1)[:, :width]
            new = np.where(near < n, np.einsum("bd,bsd->bs", q[live], x[np.minimum(near, n - 1)]), -np.inf)
            a = np.concatenate([a, np.where(near < n, near, -1)], 1)
            s = np.concatenate([s, new], 1)
            f = np.concatenate([f, near >= n], 1)
            keep = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
            a, s, f = (np.take_along_axis(y, keep, 1) for y in (a, s, f))
        at[live], score[live], done[live] = a, s, f
    return at, score


def descend(q: np.ndarray, x: np.ndarray, nodes: list, links: list, width: int, last: int | None = None) -> np.ndarray:
    """Positions among all nodes (-1 for none) of the best `width` that a walk down the levels finds, `last` on
    the lowest. q and x are lifted."""
    at = np.broadcast_to(np.arange(len(nodes[-1])), (len(q), len(nodes[-1]))).copy()
    for level in range(len(nodes) - 1, -1, -1):
        at, _ = beam(q, x[nodes[level]], links[level], at, width if level or not last else last)
        at = np.where(at >= 0, nodes[level][np.maximum(at, 0)], -1)
        if level:
            at = np.where(at >= 0, np.searchsorted(nodes[level - 1], at), -1)
    return at


def search(q: np.ndarray, up: np.ndarray, nodes: list, links: list, ef: int) -> np.ndarray:
    """Positions (b, ef) of what the walk found, -1 where fewer. up: the lifted nodes."""
    q = q / np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)
    q = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
    return descend(q, up, nodes, links, max(16, ef // 4), ef)


def first_only(start: np.ndarray) -> np.ndarray:
    """Repeats in a row become -1."""
    out = np.sort(start, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(vec, ids): each vector with its k + 1 smallest ids, which is as far as a result can reach among equal
    scores. Catalyst turns the filter on the rank into a limit per group before the shuffle."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    return vectors.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


#: Nodes of the smallest shards, and of the largest; bytes of vectors in a shard.
BASE, LARGEST, SHARD_BYTES = 8192, 131072, 1 << 27


def shard_rows_for(rows: int, d: int) -> int:
    """Nodes of a shard. Each query goes to each shard, so shards grow with the root of the number of rows: copies of queries
    grow by rows ** 1.5 and not by its square, up to what a task can hold of d components a row."""
    return max(1, min(max(BASE, 16 * math.isqrt(rows)), LARGEST, SHARD_BYTES // (8 * max(1, d))))


def beam_for(nodes: int, ef: int) -> int:
    """The width of a search: ef up to BASE nodes, beyond them wider by the root of the shard's size, which keeps recall."""
    return max(ef, math.ceil(ef * math.sqrt(nodes / BASE)))


def build_index(nodes: DataFrame, shard_rows: int | None = None, m: int = 16, wide: int = 48, ratio: int = 16) -> DataFrame:
    """One row per shard (see INDEX). nodes: (vec array<double>, ids array<long>), every one is indexed."""
    rows, d = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    shards = max(1, -(-rows // (shard_rows or shard_rows_for(rows, d))))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[i[0] for i in rows.ids]).sort_values("first", kind="stable")
        x = np.stack(rows.vec.to_numpy()).astype(np.float64)
        at, links = build(x, m, wide, ratio)
        counts = np.array([len(i) for i in rows.ids], np.int32)
        return pd.DataFrame([{"d": key[0], "shard": key[1], "n": len(x), "ids": np.concatenate(rows.ids.to_list()).astype(np.int64).tobytes(), "id_counts": counts.tobytes(), "vectors": x.tobytes(), "nodes": [a.tobytes() for a in at], "links": [a.tobytes() for a in links]}])

    dealt = nodes.withColumns({"d": F.size("vec"), "shard": F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")})
    return dealt.groupBy("d", "shard").applyInPandas(one, INDEX)


class Shard:
    """A row of the index, ready for searches."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["d"])
        self.ids, self.counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_counts"], np.int32)
        self.first = np.cumsum(self.counts) - self.counts
        self.nodes = [np.frombuffer(a, np.int32) for a in row["nodes"]]
        self.links = [np.frombuffer(a, np.int32).reshape(len(at), -1) for a, at in zip(row["links"], self.nodes)]
        self.up = lifted(self.x)

    def best(self, q: np.ndarray, own: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score), up to k of each query, its own id left out."""
        at = search(q, self.up, self.nodes, self.links, ef)
        for r in np.flatnonzero((at >= 0).sum(1) < min(len(self.x), k + 1)):  # a graph in parts: look at all
            near = np.argsort(-(self.x @ q[r]), kind="stable")[:ef]
            at[r] = -1
            at[r, : len(near)] = near
        r, c = np.nonzero(at >= 0)
        node = at[r, c]
        score = np.einsum("bd,bd->b", q[r], self.x[node])
        times = self.counts[node]
        slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, ids, score = np.repeat(r, times), self.ids[np.repeat(self.first[node], times) + slot], np.repeat(score, times)
        other = ids != own[row]
        row, ids, score = row[other], ids[other], score[other]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], ids[keep], score[keep]


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = 192, query_rows: int = 65536) -> DataFrame:
    """queries: (vec_id, vec). Returns query_id, rank, vec_id, score. The row of a shard leads its partition's rows of
    that shard and block, so that queries stream past it."""
    blocks = max(1, -(-queries.count() // query_rows))
    keys = ["d", "shard", "block"]
    number = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)).cast("int")
    asked = queries.select(F.size("vec").alias("d"), number.alias("block"), F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    fields = [c.split()[0] for c in INDEX.split(", ") if c.split()[0] not in ("d", "shard")]
    # One key and number of shards a row: the join is small, and every query needs every shard of its kind.
    visits = asked.join(index.select("d", "shard"), "d").select(*keys, "query_id", "q", F.lit(None).cast(index.select(F.struct(*fields)).schema[0].dataType).alias("index"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*keys, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("q"), F.struct(*fields).alias("index"))
    found_schema = "query_id long, vec_id long, score double"

    def run(batches):
        shard, key = None, None
        for b in batches:
            d, s, block, ids = (b.column(c).to_pylist() for c in (*keys, "query_id"))
            starts = sorted({0, *(i for i, x in enumerate(ids) if x is None)})
            for lo, hi in zip(starts, [*starts[1:], len(ids)]):
                if lo < hi and ids[lo] is None:
                    shard, key = Shard({**b.column("index")[lo].as_py(), "d": d[lo]}), (d[lo], s[lo], block[lo])
                    lo += 1
                if lo >= hi:
                    continue
                if key != (d[lo], s[lo], block[lo]):
                    raise ValueError("queries came without their shard")
                q = np.asarray(b.column("q").slice(lo, hi - lo).flatten(), np.float64).reshape(hi - lo, d[lo])
                own = np.array(ids[lo:hi], np.int64)
                for a in range(0, len(q), 256):
                    row, who, score = shard.best(q[a : a + 256], own[a : a + 256], k, beam_for(len(shard.x), ef))
                    yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 256][row]), pa.array(who), pa.array(score)], ["query_id", "vec_id", "score"])

    rows = copies.union(visits).repartition(*keys).sortWithinPartitions(*keys, F.col("query_id").isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    found = rows.mapInArrow(run, found_schema)
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """Index every row, then search for the rows whose id is divisible by `every`."""
    rows = usable_vectors(vectors, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    rows = settled(rows, "hnsw-vectors")
    index = settled(build_index(settled(distinct_vectors(rows, k), "hnsw-nodes"), **how), "hnsw-index")
    return search_index(index, rows.filter(F.col("vec_id") % every == 0), k=k)
