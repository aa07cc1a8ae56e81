"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint has bit i set if over half of its shingles' XXH64 values have it. Equal
fingerprints are one node. Each fingerprint maps to the vector of its segments' bit counts. A bit that
differs moves one count by one, so the Manhattan distance of two vectors is a lower bound of the Hamming
distance. The grid join runs on cells of that embedding: every
fingerprint goes to the cells within distance 1 of its vector, and two fingerprints within 2 of each other
always share one. Cells with one fingerprint are done. In the others the exact check follows: a fingerprint
names the 64-bit values of that cell at Hamming distance 1 or less; two fingerprints within 2 bits always
share such a value and two that share one are within 2 bits. So links need no list of all pairs: the members
of a value link to its smallest. Components come from min-label rounds over those links.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null doc_id keeps its row,
takes its component's smallest id, and null only if no member has one. Repeated rows each come out. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces, settled

SEED = 42
SEGMENTS = 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """bytes.lower() and bytes.split() change and split ASCII only, which is what is wanted."""
    words = text.lower().split()
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):  # so that a very long text needs no large matrix
        total += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in pieces(batches):
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def cells_of(fps: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the packed bit counts of its segments (three bits each, 0 to 4, in a uint64)
    and its neighbour cells (n, 1 + 2 * segments): none changed, then one count less and one more."""
    width = 64 // segments
    x = fps.view(np.uint64)
    packed = np.zeros(len(x), np.uint64)
    for s in range(segments):
        part = (x >> np.uint64(s * width)) & np.uint64(2**width - 1)
        packed |= np.bitwise_count(part).astype(np.uint64) << np.uint64(3 * s)
    steps = np.array([0] + [sign << (3 * s) for s in range(segments) for sign in (-1, 1)], np.int64)
    return packed, packed.view(np.int64)[:, None] + steps[None, :]


def grid_cells(nodes: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(fp, slot, cell): the cells within Manhattan distance 1 of each fingerprint's bit counts that some
    64-bit value has. slot: 0 its own, then 2s + 1 one less and 2s + 2 one more in segment s."""
    width = 64 // segments

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 20_000):
                fps = np.asarray(b.column("fp"), dtype=np.int64)[lo : lo + 20_000]
                packed, cells = cells_of(fps, segments)
                count = (packed[:, None] >> (3 * np.arange(segments, dtype=np.uint64))[None, :]) & np.uint64(7)
                ok = np.ones(cells.shape, bool)
                ok[:, 1::2], ok[:, 2::2] = count > 0, count < width
                i, slot = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(slot.astype(np.int32)), pa.array(cells[i, slot])], ["fp", "slot", "cell"])

    return nodes.select("fp").mapInArrow(run, "fp long, slot int, cell long")


def midpoints(placed: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(mid, fp): for each (fp, slot) the values at one flipped bit that lie in that cell, or fp itself."""
    width = 64 // segments

    def run(batches):
        for b in batches:
            fps, slot = np.asarray(b.column("fp"), dtype=np.int64).view(np.uint64), np.asarray(b.column("slot"), dtype=np.int64)
            mids, who = [fps[slot == 0]], [fps[slot == 0]]
            up, seg = slot % 2 == 0, (slot - 1) // 2
            for k in range(width):
                bit = np.uint64(1) << (np.maximum(seg, 0) * width + k).astype(np.uint64)
                hit = (slot > 0) & (((fps & bit) == 0) == up)
                mids.append(fps[hit] ^ bit[hit])
                who.append(fps[hit])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(mids).view(np.int64)), pa.array(np.concatenate(who).view(np.int64))], ["mid", "fp"])

    return placed.select("fp", "slot").mapInArrow(run, "mid long, fp long")


def links(nodes: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) links between distinct fingerprints, enough that all within 2 bits are connected."""
    placed = settled(grid_cells(nodes, segments), "simhash-cells")
    shared = placed.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo != hi").select("cell")
    mids = midpoints(placed.join(shared, "cell", "left_semi"), segments)
    mids = settled(mids, "simhash-mids")
    least = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).filter("a != hi").select("mid", "a")
    return mids.join(least, "mid").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest it reaches. Large-star and small-star
    rounds (each node sends its neighbours to the least one) until nothing changes; each round is cut off
    by a reliable checkpoint."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs (u, v): u's neighbourhood, u included, is sent to its least member."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(least, "u")
        far = joined.filter(F.col("v") > F.col("u")) if large else joined
        out = far.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(joined.select("u", F.col("m").alias("v")))
        return out.filter("u != v").distinct()

    def signature(pairs: DataFrame) -> tuple:
        """The number of links and two 64-bit digests of them: one small job, in place of comparing tables."""
        h = F.xxhash64("u", "v")
        return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(F.xxhash64(F.lit("again"), "u", "v").cast("decimal(38,0)"))).first())

    seen = signature(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now, was = checkpointed(star(star(both, True), False)), seen
        seen = signature(now)
        if seen == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over fingerprints within 2 bits)."""
    rows = settled(fingerprints(docs, width), "simhash-rows")
    nodes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = settled(components(links(nodes, segments)), "simhash-roots")
    ids = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = settled(ids.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(class_of, "fp").select("doc_id", "fp", "component_id")
