"""Near-duplicate embeddings by small-world graphs.

Equal vectors are one node. Nodes are dealt into shards by a hash, apart by number of components; each shard is one
row of an index table, with the graph of `hnsw`. Every node is a query to every shard: of two shards one searches
the other, in a circle, so that each is searched by half of them, and a shard's queries travel as one packed
row. A walk costs about the same in a shard of twice the size, so shards are as large as a task's bit table of a shard's own
links (n² bits, 134 MB for 32,768 nodes) allows: the searches are fewer by their size. A search is by range: where half of a beam's finds are links, the beam was too narrow for that query and is
widened eightfold, at last to the whole shard (one product with all of it costs less than a walk that keeps a
sixteenth of it), so a crowd of near copies loses no link to the width.

The width to begin with is found by audits: a sample of nodes, a fixed number, is held against all vectors by plain
products, and the beam is doubled until the graphs find the wanted part of the sample's links.

Cosines of what is found are computed in double precision from the vectors, and only those that reach the threshold
are links. Links are counted in the task that finds them and never listed in pairs: what leaves a task is one
row per linked node with its number of links and one neighbour, and for the searched shard one row per node with its
representative, so a crowd of g nodes gives g rows a shard and not g². Components are joined from those rows.

Nulls: a vector that is null, empty, all zero, or holds nulls or non-finite numbers links with nothing. A row
with a null id takes part with its vector; its component is the smallest id, and it is kept only if the component
has none. Repeated rows each come out and link with each other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import settled, spread_join
from .hnsw import build, lifted, search
from .simhash import components

#: ids, times (rows with that vector): int64; unit: float64, rows of d.
INDEX = "d int, shard int, n int, ids binary, times binary, unit binary, levels array<binary>, links array<binary>"

#: A beam of this part of a shard is not walked: the whole shard is compared.
SCAN = 16


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("bd,bd->b", x, x))[:, None]


def usable(vec: str) -> F.Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def build_index(nodes: DataFrame, shard_rows: int, m: int, wide: int) -> tuple[DataFrame, int]:
    """One row per shard (see INDEX) and the number of shards. nodes: node, vec, n."""
    shards = max(1, -(-nodes.count() // shard_rows))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        x = unit(np.stack(rows.vec.to_numpy()).astype(np.float64))
        levels, links = build(x, m, wide)
        ids, times = rows.node.to_numpy(np.int64), rows.n.to_numpy(np.int64)
        return pd.DataFrame([{"d": key[0], "shard": key[1], "n": len(x), "ids": ids.tobytes(), "times": times.tobytes(), "unit": x.tobytes(), "levels": [a.tobytes() for a in levels], "links": [a.tobytes() for a in links]}])

    dealt = nodes.withColumns({"d": F.size("vec"), "shard": F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")})
    return dealt.groupBy("d", "shard").applyInPandas(one, INDEX), shards


def lower_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest position that each reaches) after u and v are joined."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        a, b, u, v = a[differ], b[differ], u[differ], v[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]


class Shard:
    """A row of the index: range search in its graph, and what was found so far."""

    def __init__(self, row: dict):
        self.n, d = row["n"], row["d"]
        self.ids, self.times = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["times"], np.int64)
        self.x = np.frombuffer(row["unit"], np.float64).reshape(self.n, d)
        self.levels = [np.frombuffer(a, np.int32) for a in row["levels"]]
        self.links = [np.frombuffer(a, np.int32).reshape(len(at), -1) for a, at in zip(row["links"], self.levels)]
        self.up = lifted(self.x)
        self.label, self.linked = np.arange(self.n), np.zeros(self.n, np.int64)

    def within(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, node position) of what is found at a cosine of `least` or more."""
        rows, found, ask = [], [], np.arange(len(q))
        while len(ask):
            if SCAN * ef >= self.n:
                r, at = np.nonzero(q[ask] @ self.x.T >= least - 1e-9)
            else:
                near = search(q[ask], self.up, self.levels, self.links, ef)
                r, c = np.nonzero(near >= 0)
                at = near[r, c]
            close = np.einsum("bd,bd->b", q[ask[r]], self.x[at]) >= least
            r, at = r[close], at[close]
            crowded = np.bincount(r, minlength=len(ask)) * 2 >= ef if SCAN * ef < self.n else np.zeros(len(ask), bool)
            rows.append(ask[r[~crowded[r]]])
            found.append(at[~crowded[r]])
            ask, ef = ask[crowded], ef * 8
        return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *found])

    def meet(self, other: dict, least: float, ef: int) -> pa.RecordBatch:
        """The links of another shard's nodes to this one's: their numbers, and for each one neighbour."""
        ids, times = np.frombuffer(other["ids"], np.int64), np.frombuffer(other["times"], np.int64)
        x = np.frombuffer(other["unit"], np.float64).reshape(len(ids), -1)
        count, first = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
        for lo in range(0, len(ids), 256):
            r, at = self.within(x[lo : lo + 256], least, ef)
            r = r + lo
            np.add.at(count, r, self.times[at])
            np.add.at(self.linked, at, times[r])
            first[r[::-1]] = at[::-1]
            self.label = lower_labels(self.label, first[r], at)
        hit = np.flatnonzero(first >= 0)
        return rows_out(ids[hit], count[hit], self.ids[first[hit]])

    def meet_own(self, least: float, ef: int) -> None:
        """The links among this shard's nodes, found from either end, as bits."""
        bits = np.zeros((self.n, -(-self.n // 8)), np.uint8)
        for lo in range(0, self.n, 256):
            r, at = self.within(self.x[lo : lo + 256], least, ef)
            r, at = (r + lo)[r + lo != at], at[r + lo != at]
            np.bitwise_or.at(bits, (r, at >> 3), (128 >> (at & 7)).astype(np.uint8))
            np.bitwise_or.at(bits, (at, r >> 3), (128 >> (r & 7)).astype(np.uint8))
            self.label = lower_labels(self.label, r, at)
        for lo in range(0, self.n, 256):
            self.linked[lo : lo + 256] += np.unpackbits(bits[lo : lo + 256], axis=1, count=self.n) @ self.times

    def result(self) -> pa.RecordBatch:
        at = np.flatnonzero((self.linked > 0) | (self.label != np.arange(self.n)))
        return rows_out(self.ids[at], self.linked[at], self.ids[self.label[at]])


def rows_out(node: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(other)], ["node", "links", "other"])


def shard_links(index: DataFrame, shards: int, least: float, ef: int, steps: int = 2) -> DataFrame:
    """(node, links, other): partial numbers of links and neighbours that connect what is linked. Each shard is searched
    by itself and by those up to half the circle before it, `steps` of them in a task."""
    half = shards // 2
    keys = ["d", "shard", "part"]
    own = ["n", "ids", "times", "unit", "levels", "links"]
    searched = index.select("d", "shard", F.explode(F.sequence(F.lit(0), F.lit(half // steps))).alias("part"), F.lit(-1).alias("step"), *own)
    step = F.explode(F.sequence(F.lit(0), F.lit(half)))
    asking = index.select("*", step.alias("step")).filter((F.col("step") * 2 < shards) | (F.col("shard") < half))
    asking = asking.select("d", F.pmod(F.col("shard") + F.col("step"), F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("step") / steps).cast("int").alias("part"), "step", "n", "ids", "times", F.when(F.col("step") > 0, F.col("unit")).alias("unit"), F.lit(None).cast("array<binary>").alias("levels"), F.lit(None).cast("array<binary>").alias("links"))

    def run(batches):
        shard, key = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                at = tuple(row[c] for c in keys)
                if row["step"] < 0:
                    if shard:
                        yield shard.result()
                    shard, key = Shard(row), at
                elif key == at:  # else the searched shard has no node of this number of components
                    if row["step"] == 0:
                        shard.meet_own(least, ef)
                    else:
                        yield shard.meet(row, least, ef)
        if shard:
            yield shard.result()

    return searched.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "step").mapInArrow(run, "node long, links long, other long")


def audited_recall(index: DataFrame, sample: list[Row], least: float, ef: int) -> float:
    """Part of the sample's true links (of any node to another) that the graphs find with this beam. sample: node, vec."""
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.vec) for r in sample}:
        own = [r for r in sample if len(r.vec) == d]
        asked[d] = np.array([r.node for r in own], np.int64), unit(np.array([r.vec for r in own], np.float64))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if row["d"] not in asked:
                    continue
                shard, (ids, q) = Shard(row), asked[row["d"]]
                true, found = 0, 0
                for lo in range(0, len(q), 256):
                    r, at = np.nonzero(q[lo : lo + 256] @ shard.x.T >= least)
                    true += np.count_nonzero(shard.ids[at] != ids[lo + r])
                    r, at = shard.within(q[lo : lo + 256], least, ef)
                    found += np.count_nonzero(shard.ids[at] != ids[lo + r])
                yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([found])], ["true", "found"])

    true, found = index.mapInArrow(run, "true long, found long").agg(F.sum("true"), F.sum("found")).first()
    return found / true if true else 1.0


def audited_width(index: DataFrame, nodes: DataFrame, least: float, ef: int, wanted: float, audited: int) -> int:
    """The first beam width, doubled from `ef`, with which the audit finds the wanted part. It ends: a beam of 1 / SCAN
    of a shard looks at the whole shard."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(audited).select("node", "vec").collect()
    while audited_recall(index, sample, least, ef) < wanted:
        ef *= 2
    return ef


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 32768, m: int = 16, wide: int = 48, ef: int = 32, wanted: float = 0.99, audited: int = 1024
) -> DataFrame:
    """vec_id, n_links (other rows at a cosine of `least` or more), component_id (smallest id reachable by links), kept
    (vec_id is component_id). wanted: part of the links that audits of `audited` nodes must find."""
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    k = ["k1", "k2"]
    key = {"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit("second"), "vec")}
    rows = settled(whole.filter(usable("vec")).select("vec_id", *[c.alias(a) for a, c in key.items()]), "embeddup-rows")
    same = whole.filter(usable("vec")).groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = settled(same.select(F.monotonically_increasing_id().alias("node"), "vec", "n", "least", *[c.alias(a) for a, c in key.items()]), "embeddup-nodes")
    index, shards = build_index(nodes, shard_rows, m, wide)
    index = settled(index, "embeddup-index")
    ef = audited_width(index, nodes, least, ef, wanted, audited)
    found = settled(shard_links(index, shards, least, ef), "embeddup-links")
    roots = settled(components(found.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b"))), "embeddup-roots")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    narrow = nodes.drop("vec").join(linked, "node", "left").join(roots, "node", "left")
    narrow = settled(narrow.select(*k, "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "embeddup-classes")
    smallest = settled(narrow.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "embeddup-smallest")
    classes = settled(spread_join(narrow, smallest, ["root"], "members").select(*k, "n", "n_links", "component_id"), "embeddup-nodes-done")
    out = spread_join(rows, classes, k, "n").select("vec_id", "n_links", "component_id")
    alone = whole.filter(~usable("vec")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.unionByName(alone).withColumn("kept", kept)
