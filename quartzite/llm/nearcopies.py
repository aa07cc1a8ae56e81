"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least `least`.

The widened form of simhash for stages that ask for a similarity. Candidates come from its fingerprints within 2
bits, by its grid join. At a similarity of 0.8 fingerprints differ in 10 of 64 bits on average (the angle
of two such sets), which no grid of bit counts can tell from chance, so MinHash bands add candidates: a text has
BANDS keys of BAND_ROWS minima each, and two texts meet where a key is equal (a pair at 0.8 meets with
probability 0.9998, one at 0.9 all but always). Every candidate pair is then checked, so no pair under `least` is
linked: sets whose sizes alone rule it out are not paired; a bitmap of each set's hashes bounds what two can share
from above, which drops nearly all other pairs; the rest is checked on the shingles themselves.

Pairs of up to FEW texts at one key are all checked. At a key with more texts each is first checked against
PIVOTS of them, those that meet most texts, as the original of a group of edited copies does. Where that leaves
a key's texts in several groups, their texts are joined exactly: texts of different groups are paired where they
share a shingle that is rare enough in both to be the first shared one of a pair at the similarity. So a large group
of copies costs about as many pairs as it has texts, and no link between groups is lost. Components come from
min-label rounds.

A node is a distinct text, named by its xxhash64. Words are cut and lowered as in simhash. A text of fewer
words than a shingle is one shingle; null and texts without a word are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, settled
from .simhash import SEED, components, fingerprint, links

BANDS, BAND_ROWS = 16, 4
FEW = 16
PIVOTS = 4
#: Bits of a set's bitmap.
BITS = 1024
#: Counters of how many texts have a shingle.
COUNTERS = 1 << 20
#: Rows of a block, where many texts share a rare shingle.
BLOCK = 2048
_R = np.random.default_rng(SEED)
FACTORS = _R.integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _R.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(text: bytes | None, width: int) -> set[bytes]:
    words = (text or b"").lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a: set, b: set) -> float:
    """Two empty sets are alike."""
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def hashes_of(sets: set) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in sets), np.uint64, len(sets))


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit is 1 if a hash falls on it."""
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(bits).tobytes()


def most_alike(size_a, size_b, bits_a, bits_b) -> np.ndarray:
    """An upper bound of the Jaccard similarity: each bit that only one set has stands for a shingle at least that only
    it has. bits: (n, words) of 64 bits."""
    only_a, only_b = (np.bitwise_count(x & ~y).sum(1, dtype=np.int64) for x, y in ((bits_a, bits_b), (bits_b, bits_a)))
    shared = np.minimum(size_a - only_a, size_b - only_b)
    return np.where(size_a + size_b > 0, shared / np.maximum(size_a + size_b - shared, 1), 1.0)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[lo : lo + 1024, None] * FACTORS[None, :] + SHIFTS[None, :]).min(0), out=low)
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(low.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def marked(docs: DataFrame, width: int) -> DataFrame:
    """(node, size, fp, bits, keys), once each: number of shingles, fingerprint, bitmap and band keys."""

    def run(batches):
        for b in pieces(batches):
            sizes, fps, bits, keys = [], [], [], []
            for t in b.column("text").cast(pa.binary()):
                text = t.as_py() or b""
                hashes = hashes_of(shingles(text, width))
                sizes.append(len(hashes))
                fps.append(fingerprint(text, width))
                bits.append(bitmap(hashes))
                keys.append(band_keys(hashes))
            columns = [b.column("node"), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "fp", "bits", "keys"])

    rows = docs.select(F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "node long, size int, fp long, bits binary, keys array<long>").dropDuplicates(["node"])


def pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): the texts of a fingerprint, and those of fingerprints within 2 bits, each by their first."""
    fps = settled(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "copies-fingerprints")
    same = nodes.join(fps, "fp").filter("node != lead").select(*pair("node", "lead"))
    near = links(fps.select("fp"))
    ends = [fps.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}")) for c in "ab"]
    return same.union(near.join(ends[0], "a").join(ends[1], "b").select(*pair("lead_a", "lead_b")))


def alike(x: str, y: str, least: float):
    """Whether two sets of these sizes can reach the similarity."""
    return F.least(x, y) >= F.greatest(x, y) * least


def met_by_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, size, n): the keys that n > 1 texts have."""
    bands = nodes.select("node", "size", F.explode("keys").alias("key"))
    counts = settled(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "copies-keys")
    return settled(bands.join(counts, "key"), "copies-met")


def candidates(met: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b: all pairs at keys of few texts, and each text with the pivots of its larger keys."""
    few, many = met.filter(F.col("n") <= FEW).select("key", "node", "size"), met.filter(F.col("n") > FEW)
    some = few.toDF("key", "a", "size_a").join(few.toDF("key", "b", "size_b"), "key").filter(F.col("a") < F.col("b")).filter(alike("size_a", "size_b", least)).select("a", "b")
    met_by = settled(many.groupBy("node").agg(F.sum("n").alias("met")), "copies-central")
    part = F.pmod(F.xxhash64("key", "node"), F.lit(PIVOTS))
    first = F.max(F.struct("met", F.xxhash64("node", "key").alias("h"), "node", "size"))
    pivots = many.join(met_by, "node").groupBy("key", part.alias("part")).agg(first.alias("pivot")).select("key", F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size"))
    stars = many.join(pivots, "key").filter("node != pivot").filter(alike("size", "pivot_size", least)).select(*pair("node", "pivot"))
    return some.union(stars)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, once each."""
    texts = docs.select(F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text")).join(nodes.select("node"), "node", "left_semi")
    return texts.groupBy("node").agg(F.first("text").alias("text"))


def undecided(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): the texts at keys of many texts that are in several groups so far, with their group."""
    many = settled(met.filter(F.col("n") > FEW).join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "copies-grouped")
    split = many.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    return settled(many.join(split, "key").select("node", "root").distinct(), "copies-split")


def rare_first(nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """(h, node, root, size, place): of each node's shingle hashes, rarest first, those that can be the first one shared
    with a text at the similarity. How rare one is comes from COUNTERS counters that hashes share, so any number of
    texts needs the same small table; a shared counter only makes a hash look less rare. Any order that all texts have in
    common is right; this one keeps frequent shingles back. A hash that is alone at its counter is left out."""
    texts = settled(texts_of(docs, nodes).join(nodes, "node"), "copies-undecided")

    def hashes(t) -> np.ndarray:
        return np.unique(hashes_of(shingles(t.as_py() or b"", width)))

    def count(batches):
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                np.add.at(n, hashes(t) % np.uint64(COUNTERS), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])

    got = texts.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int64)
    counts[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    known = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for b in pieces(batches):
            at, kept, places, sizes = [], [], [], []
            for i, t in enumerate(b.column("text").cast(pa.binary())):
                h = hashes(t)
                seen = known.value[h % np.uint64(COUNTERS)]
                order = np.lexsort((h, seen))
                first = order[: int(len(h) * (1 - least) + 1e-6) + 1]
                place = np.flatnonzero(seen[first] > 1)
                at.append(np.full(len(place), i))
                kept.append(h[first[place]])
                places.append(place)
                sizes.append(np.full(len(place), len(h)))
            flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
            rows = flat(at, np.int64)
            columns = [pa.array(np.concatenate(kept).view(np.int64)), b.column("node").take(rows), b.column("root").take(rows), flat(sizes, np.int32), flat(places, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "node", "root", "size", "place"])

    return texts.select("node", "root", "text").mapInArrow(run, "h long, node long, root long, size int, place int")


def in_blocks(left: DataFrame, right: DataFrame, key: str, condition) -> DataFrame:
    """left join right on the key and the condition, both cut into blocks where many rows have a key."""
    sizes = left.groupBy(key).agg(F.count("*").alias("rows")).join(right.groupBy(key).agg(F.count("*").alias("columns")), key)
    sizes = settled(sizes.select(key, *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("rows", "columns")]), "copies-blocks")
    number = lambda side, n: F.pmod(F.xxhash64(f"node_{side}"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, key).withColumn("row", number("a", F.col("rows"))).withColumn("column", every("columns")).drop("rows", "columns")
    b = right.join(sizes, key).withColumn("column", number("b", F.col("columns"))).withColumn("row", every("rows")).drop("rows", "columns")
    a, b = (x.select(*[F.col(c).alias(f"{side}_{c}" if c in (key, "row", "column") else c) for c in x.columns]) for side, x in (("left", a), ("right", b)))
    same = F.lit(True)
    for c in (key, "row", "column"):
        same &= F.col(f"left_{c}") == F.col(f"right_{c}")
    return a.join(b, same & condition)


def apart(nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): the pairs of nodes of different groups that can have the similarity. Two sets of sizes s and t that
    have it share q (s + t) shingles, with q = least / (1 + least). So their first shared one, rarest first, has at most
    s - q (s + t) before it in the one and t - q (s + t) in the other; texts that share no such shingle are never paired.
    A group of texts that differ too much hence meets at few shingles, or at none."""
    q = least / (1 + least)
    tokens = settled(rare_first(nodes, docs, width, least), "copies-rare")
    main = tokens.groupBy("h", "root").agg(F.count("*").alias("members")).groupBy("h").agg(F.max(F.struct("members", "root")).alias("main"), F.min("root").alias("low"), F.max("root").alias("high"))
    main = settled(main.filter("low != high").select("h", F.col("main.root").alias("main")), "copies-main")
    rows = settled(tokens.join(main, "h"), "copies-tokens")
    # The larger set is on the left; the smaller has its shared shingle among its very first.
    left = rows.select("h", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "place")], (F.col("root") == F.col("main")).alias("main_a"))
    right = rows.filter(F.col("place") <= F.col("size") * (1 - 2 * q) + 1e-6).select("h", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "place")], (F.col("root") == F.col("main")).alias("main_b"))
    shared = (F.col("size_a") + F.col("size_b")) * q
    larger = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("node_a") > F.col("node_b")))
    possible_ = [F.col(f"place_{c}") + shared <= F.col(f"size_{c}") + 1e-6 for c in "ab"]
    condition = (F.col("root_a") != F.col("root_b")) & larger & possible_[0] & possible_[1] & alike("size_a", "size_b", least)
    met = in_blocks(left, right.filter("not main_b"), "h", condition).select("node_a", "node_b")
    met = met.union(in_blocks(left.filter("not main_a"), right.filter("main_b"), "h", condition).select("node_a", "node_b"))
    return met.select(*pair("node_a", "node_b"))


def possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sizes and bitmaps allow the similarity."""
    ends = [nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b")

    def run(batches):
        for batch in batches:
            sizes = [np.asarray(batch.column(f"size_{c}"), dtype=np.int64) for c in "ab"]
            bits = [np.frombuffer(b"".join(batch.column(f"bits_{c}").to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in "ab"]
            ok = pa.array(most_alike(*sizes, *bits) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, found: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs whose Jaccard similarity is at least `least`, by their texts. found: the nodes (see marked)."""
    pairs = settled(possible(pairs.distinct(), found, least), "copies-pairs")
    ends = settled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "copies-ends")
    texts = settled(texts_of(docs, ends), "copies-texts")
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in pieces(batches):
            seen: dict[int, set] = {}

            def of(node, text):
                if node not in seen:
                    seen[node] = shingles(text, width)
                return seen[node]

            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            x, y = x.cast(pa.binary()), y.cast(pa.binary())
            ok = pa.array([jaccard(of(a[i].as_py(), x[i].as_py()), of(b[i].as_py(), y[i].as_py())) >= least for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of the texts that have a near copy: root is the smallest node of their group."""
    nodes = settled(marked(docs, width), "copies-nodes")
    met = met_by_keys(nodes)
    found = settled(similar(candidates(met, least).union(by_fingerprint(nodes)), nodes, docs, width, least), "copies-links")
    roots = settled(components(found), "copies-groups")
    left = undecided(met, roots)
    more = settled(similar(apart(left, docs, width, least), nodes, docs, width, least), "copies-more")
    if more.isEmpty():
        return roots
    return settled(components(found.union(more)), "copies-roots")
