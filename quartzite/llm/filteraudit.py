"""Interaction audit of document filters over a sparse document-term matrix.

Texts are cut into blocks; each becomes a shard of the matrix in CSR form: a row per document, its distinct words
as columns with their counts. A shard is first coded by its own dictionary. The shards' dictionaries meet in one
shuffle by word, where every word gets its number in the whole collection: words are ranked inside buckets of
their hash, so a number is a function of the data alone. The numbers go back to the shards, which then hold
them as column indices. So what moves is one row per word and shard, not per word and document, and a very
common word is as many rows as there are shards.

Of a row, the sum is the document's number of words and the count of nonzeros that of its distinct words; they
decide two of five filters, expressions on the text the others:

    A  under 200 words            B  distinct words under half of the words
    C  capitals A-Z over 2 % of the code points          D  a character of #$%&*|
    E  identical to the text of a smaller doc_id

Copies are found without a group per text: the least doc_id of each text's SHA-256 is joined on digest and
doc_id, a key that hardly two rows share. Counts then go by part and by the set of failed filters (32 at most),
and each of the 120 orders of filters reads its numbers off those counts.

Nulls: a null text is empty; a null source is the part ''; a row with a null doc_id is audited, is no copy, and
has no labels. Repeated rows each count, and are no copies of each other (their doc_id is the same). A document
is good or toxic if any of its label rows says so. Very long texts are blocks of their own. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled
from .wordcodes import BLOCK_BYTES, blocks, word_codes

FILTERS = "ABCDE"
MIN_WORDS = 200
OF = "struct<doc_id:bigint,part:string,digest:binary,c:boolean,d:boolean>"
#: docs: a row per document. nnz: nonzeros of each row (int32). columns: words' codes, ascending within a row, as
#: differences (int32; the first of a row is its code). counts: int32. All binaries are zstd; size: nonzeros.
LOCAL = f"shard long, docs array<{OF}>, size long, nnz binary, columns binary, counts binary, words array<binary>"
#: As above, but columns are the words' numbers in the whole collection (int64), as they are.
CSR = f"shard long, docs array<{OF}>, size long, nnz binary, columns binary, counts binary"


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def rows_of(codes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows of coded words: (nonzeros of each row, columns ascending within a row, counts)."""
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
    keys = np.sort(row * max(width, 1) + codes)
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, counts = keys[new], np.diff(np.append(new, len(keys)))
    return np.bincount(keys // max(width, 1), minlength=len(starts) - 1), keys % max(width, 1), counts


def audited_rows(docs: DataFrame) -> DataFrame:
    """(text, of): what the matrix and the other filters need of a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    of = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        (100 * capitals > 2 * F.length(text)).alias("c"), text.rlike("[#$%&*|]").alias("d"),
    )
    return docs.select(text.alias("text"), of.alias("of"))


def local_shards(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Shards of the matrix by their own dictionaries (see LOCAL). Their numbers are unique in one run only, so
    write the table before it is read twice."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for nth, b in enumerate(blocks(batches, limit)):
            codes, starts, words = word_codes(b.column("text"))
            nnz, columns, counts = rows_of(codes, starts, len(words))
            step = np.diff(columns, prepend=0)
            first = (np.cumsum(nnz) - nnz)[nnz > 0]
            step[first] = columns[first]
            of = b.column("of").combine_chunks()
            of = pa.concat_arrays(of.chunks) if isinstance(of, pa.ChunkedArray) else of
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + nth]), pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of), pa.array([len(columns)]), pa.array([packed(nnz.astype(np.int32))]),
                    pa.array([packed(step.astype(np.int32))]), pa.array([packed(counts.astype(np.int32))]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())),
                ],
                ["shard", "docs", "size", "nnz", "columns", "counts", "words"],
            )

    return audited_rows(docs).mapInArrow(run, LOCAL)


def numbered_words(shards: DataFrame, bucket_words: int = 200_000) -> DataFrame:
    """(shard, code, word, number): every shard's dictionary with the words' numbers in the whole collection: rank
    in a bucket of the hash, times buckets, plus the bucket."""
    n = shards.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    buckets = max(1, -(-n // bucket_words))
    each = shards.select("shard", F.posexplode("words").alias("code", "word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    rank = F.expr("dense_rank() over (partition by bucket order by word)").cast("long")
    return each.select("shard", "code", "word", ((rank - 1) * buckets + F.col("bucket")).alias("number"))


def csr_shards(shards: DataFrame, numbers: DataFrame) -> DataFrame:
    """Shards with the words' numbers in place of their codes (see CSR)."""
    maps = numbers.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("code", "number")))["number"].alias("numbers"))
    names = [f.split()[0] for f in ("shard", "docs", "size", "nnz", "columns", "counts")]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                size = b.column("size")[i].as_py()
                nnz = unpacked(b.column("nnz")[i].as_py(), np.int32, len(b.column("docs")[i]))
                ends = np.cumsum(nnz, dtype=np.int64)
                sums = np.cumsum(unpacked(b.column("columns")[i].as_py(), np.int32, size), dtype=np.int64)
                before = np.append(0, sums)[ends - nnz]
                numbers = np.asarray(b.column("numbers")[i].values) if size else np.zeros(0, np.int64)
                columns = numbers[sums - np.repeat(before, nnz)]
                yield pa.RecordBatch.from_arrays([pa.array([packed(columns)]) if c == "columns" else b.column(c).slice(i, 1) for c in names], names)

    return shards.drop("words").join(maps, "shard", "left").mapInArrow(run, CSR)


def row_totals(matrix: DataFrame) -> DataFrame:
    """A row per document: doc_id, part, digest, c, d, n_words (sum of its row), n_distinct (nonzeros)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                of, size = b.column("docs")[i].values, b.column("size")[i].as_py()
                nnz = unpacked(b.column("nnz")[i].as_py(), np.int32, len(of))
                counts = unpacked(b.column("counts")[i].as_py(), np.int32, size)
                total = np.bincount(np.repeat(np.arange(len(of)), nnz), counts, len(of)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*of.flatten(), pa.array(total), pa.array(nnz.astype(np.int64))], ["doc_id", "part", "digest", "c", "d", "n_words", "n_distinct"])

    return matrix.select("docs", "size", "nnz", "counts").mapInArrow(run, "doc_id long, part string, digest binary, c boolean, d boolean, n_words long, n_distinct long")


def failures(docs: DataFrame, labels: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """A row per distinct (doc_id, part, text) with n (its rows), failed (bit i: filter i) and good, toxic (0, 1)."""
    shards = settled(local_shards(docs, limit), "audit-shards")
    rows = row_totals(csr_shards(shards, numbered_words(shards)))
    short, poor = F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < 50 * F.col("n_words")
    failed = sum((flag.cast("int") * 2**i for i, flag in enumerate((short, poor, F.col("c"), F.col("d")))), F.lit(0))
    rows = settled(rows.groupBy("digest", "doc_id", "part", failed.alias("failed")).agg(F.count("*").alias("n")), "audit-rows")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("salt", F.lit(0))
    salted = rows.join(least, ["digest", "doc_id"], "left").withColumn("salt", F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0))  # null ids match nothing, but must not meet in one task
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return salted.join(marks, ["doc_id", "salt"], "left").select("doc_id", "part", "n", (F.col("failed") + copy.cast("int") * 16).alias("failed"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def plan() -> str:
    """As JSON, each order and step with the sets of failed filters that it keeps, removes, or finds removed."""
    sets, out = range(2 ** len(FILTERS)), []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            bit = 1 << i
            kept, removed, redundant = [s for s in sets if not s & (before | bit)], [s for s in sets if s & bit and not s & before], [s for s in sets if s & bit and s & before]
            out.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step, "bit": bit, "kept": kept, "removed": removed, "redundant": redundant})
            before |= bit
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """part, filter_order, step and kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per
    part, order of the filters and step."""
    orders, sets = 120, range(2 ** len(FILTERS))
    total = lambda c: F.array(*[F.sum(F.when(F.col("failed") == s, c).otherwise(0)).cast("long") for s in sets])
    parts = failures(docs, labels, limit).groupBy("part").agg(total(F.col("n")).alias("n"), total(F.col("n") * F.col("good")).alias("good"), total(F.col("n") * F.col("toxic")).alias("toxic"))
    schema = "array<struct<filter_order:string,step:int,bit:int,kept:array<int>,removed:array<int>,redundant:array<int>>>"
    steps = parts.select("part", "n", "good", "toxic", F.inline(F.from_json(F.lit(plan()), schema)))
    none = F.lit(0).cast("long")

    def over(which: Column, counts: str, weight=lambda s: F.lit(1)) -> Column:
        return F.aggregate(which, none, lambda acc, s: acc + F.get(F.col(counts), s) * weight(s))

    # A document that fails k filters is removed by each of them in orders / k of the orders.
    share = over(F.array_union("removed", "redundant"), "n", lambda s: (orders / F.bit_count(s)).cast("long"))
    return steps.select(
        "part", "filter_order", "step", over(F.col("kept"), "n").alias("kept"), over(F.col("removed"), "n").alias("removed"), over(F.col("redundant"), "n").alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"), over(F.col("removed"), "good").alias("good_lost"), over(F.col("removed"), "toxic").alias("toxic_lost"), share.alias("shapley"),
    )
