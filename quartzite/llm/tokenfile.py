"""Token-id files coded by a static range asymmetric numeral system.

Documents are tokenised, an end id is added to each, and all ids are counted into one frequency table,
scaled to 2^20 and shared by all blocks. Documents go to ranges of doc_id; each range is cut into blocks of
whole documents. A block holds its ids interleaved over many lanes, each lane a 64-bit state that spills
32-bit words, so coding and decoding work on all lanes at once. A block also holds its documents' ids and
lengths, its offset in its range (the checkpoint from which it is decoded without any other block) and a
checksum. Blocks are rows of Parquet files in ascending doc_id order, next to the frequency table and one
small table with the first position of each range.

Nulls: a null text is empty and has the end id only; a null doc_id comes first. Repeated rows each come
out. Ids take 16 bits on the way, 32 where the vocabulary is larger. A document longer than a block makes a block of its own. An empty table gives no rows. Other columns do
not matter.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, pieces, settled

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK_TOKENS = 1 << 19
LANES = 2048
BLOCKS = "part int, block int, offset long, n_tokens long, crc32 long, lanes int, doc_ids array<long>, doc_tokens array<int>, states binary, words binary"

#: Texts with none of these characters are cut at white space and looked up word by word.
OTHER = "[^\t\n\r\\x0b\\x0c -~¡-įı-ɏ]|<\\|"
#: The pre-tokeniser's pattern.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: A full stop or comma next to another sign, with which it makes one piece.
JOINED = r"[.,][^\s\x0b\p{L}\p{N}]|[^\s\x0b\p{L}\p{N}][.,]"


def id_type(vocabulary: int) -> str:
    """Little-endian unsigned integers that hold every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class WordTokenizer:
    """The tokenizers library behind a memory of words. No token crosses the pieces of the pre-tokeniser's
    pattern, and no piece crosses white space, so a text's ids are those of its words one after the other. Arrow
    splits the texts of a batch (full stops and commas that stand alone come off first) and finds the distinct
    words. New ones are cut into pieces, mostly one each, and new pieces go to the library, all in one call: each ends
    with an id whose token ends in the end-of-word mark, so its ids can be cut apart there. Texts with
    characters outside Latin go to the library whole. The memory is emptied when full, which costs time and
    changes nothing."""

    def __init__(self, path: str, most: int = 500_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.kind = np.dtype(id_type(self.size))
        self.ends = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.split = regex.compile(PIECE).findall
        self.most, self.words = most, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn_pieces(self, pieces: list) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            self.words.update((p, self.whole(p)) for p in pieces)
            return
        raw, at = ids.tobytes(), [0, *(ends * self.kind.itemsize).tolist()]
        self.words.update((p, raw[a:b]) for p, a, b in zip(pieces, at, at[1:]))

    def learn(self, words: list) -> None:
        mixed = [(w, self.split(w)) for w in words if not w.isalpha()]
        new = {w for w in words if w.isalpha()}.union(*(p for _, p in mixed)) - self.words.keys()
        if new:
            self.learn_pieces(list(new))
        get = self.words.__getitem__
        self.words.update([(w, b"".join(map(get, p))) for w, p in mixed])

    def encode(self, texts: pa.Array) -> list:
        """The ids of each text as bytes; a null text is empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, OTHER)
        lower = pc.utf8_lower(pc.if_else(odd, "", texts))
        apart = pc.replace_substring(pc.replace_substring(lower, ".", " . "), ",", " , ")
        rows = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(lower, JOINED), lower, apart))
        coded = rows.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) + len(distinct) > self.most:
            self.words.clear()
        known = self.words
        new = [w for w in distinct if w not in known]
        if new:
            self.learn(new)
        ids = pa.array([known[w] for w in distinct], pa.binary()).take(coded.indices)
        data = memoryview(ids.buffers()[2] or b"")
        at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)[rows.offsets.to_numpy() - rows.offsets[0].as_py()] if len(ids) else np.zeros(len(texts) + 1, np.int32)
        at = at.tolist()
        return [self.whole(texts[i].as_py()) if o else bytes(data[at[i] : at[i + 1]]) for i, o in enumerate(odd.to_pylist())]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary_size(path: str, end_id: int) -> int:
    return max(tokenizer(path).size, end_id + 1)


def tokens(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian bytes of that kind, the end id last."""
    end = np.array([end_id], kind).tobytes()

    def run(batches):
        coder = tokenizer(path)
        for b in batches:  # not in small pieces: the more texts at once, the fewer words are new
            ids = coder.encode(b.column("text"))
            if coder.kind != np.dtype(kind):
                ids = [np.frombuffer(x, coder.kind).astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def counted(ids: DataFrame, kind: str, size: int) -> DataFrame:
    """(id, n): how often each id occurs in all documents."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            for part in pieces([b]):
                n += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequency_table(n: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to 2^20, none that occurs below 1. At most 2^20 ids can occur."""
    freq = np.zeros(len(n), np.int64)
    seen = n > 0
    if not seen.any():
        return freq
    freq[seen] = np.maximum(1, np.floor(n[seen] * ((1 << SCALE) / n.sum())).astype(np.int64))
    over = int(freq.sum()) - (1 << SCALE)
    for i in np.argsort(-freq, kind="stable"):
        if over == 0:
            break
        step = max(min(over, int(freq[i]) - 1), 1 - int(freq[i])) if over > 0 else over
        freq[i] -= step
        over -= step
    return freq


def rans_encode(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(states, words). Symbols go to the lanes in turn; coded from the last to the first."""
    x = np.full(lanes, LOW, np.uint64)
    out = []
    shift, m = np.uint64(63 - SCALE), np.uint64(SCALE)
    for lo in range((len(symbols) - 1) // lanes * lanes, -1, -lanes):
        s = symbols[lo : lo + lanes]
        f, c, y = freq[s], start[s], x[: len(s)]
        over = y >= f << shift
        if over.any():
            out.append((y[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[: len(s)] = (q << m) + (y - q * f) + c
    return x, np.concatenate(out[::-1]) if out else np.empty(0, "<u4")


def rans_decode(n: int, states: np.ndarray, words: np.ndarray, freq: np.ndarray, start: np.ndarray, symbol_of: np.ndarray) -> np.ndarray:
    x, lanes, at = states.copy(), len(states), 0
    out = np.empty(n, symbol_of.dtype)
    mask, m = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for lo in range(0, n, lanes):
        y = x[: n - lo]
        slot = y & mask
        s = symbol_of[slot]
        y = freq[s] * (y >> m) + slot - start[s]
        under = np.flatnonzero(y < LOW)
        if len(under):
            y[under] = (y[under] << np.uint64(32)) | words[at : at + len(under)]
            at += len(under)
        x[: len(y)] = y
        out[lo : lo + len(y)] = s
    if at != len(words) or (x != LOW).any():
        raise ValueError("a block does not end where it began")
    return out


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 64))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write path/blocks, path/frequencies and path/ranges."""
    spark = docs.sparkSession
    size = vocabulary_size(tokenizer_path, end_id)
    kind = id_type(size)
    ids = settled(tokens(docs, tokenizer_path, end_id, kind), "token-ids")
    table = counted(ids, kind, size).toPandas()  # a row per id of the vocabulary
    n = np.zeros(size, np.int64)
    n[table["id"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    f = frequency_table(n)
    used = np.flatnonzero(f)
    spark.createDataFrame([(int(i), int(f[i])) for i in used], "id int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")
    known = spark.sparkContext.broadcast(f.astype(np.uint32))

    def run(batches):
        freq = known.value.astype(np.uint64)
        start = (np.cumsum(freq) - freq).astype(np.uint64)
        held, size, block, offset, part = [], 0, 0, 0, None
        width = np.dtype(kind).itemsize

        def made():
            symbols = np.frombuffer(b"".join(x for _, x in held), kind)
            states, words = rans_encode(symbols, freq, start, lanes_for(len(symbols)))
            row = [part, block, offset, len(symbols), zlib.crc32(symbols.astype("<u4").tobytes()), len(states), [i for i, _ in held], [len(x) // width for _, x in held], states.astype("<u8").tobytes(), words.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for i, x, p in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("part").to_pylist()):
                part = p
                held.append((i, x.as_py()))
                size += len(held[-1][1]) // width
                if size >= block_tokens:
                    yield made()
                    held, block, offset, size = [], block + 1, offset + size, 0
        if held:
            yield made()

    # Rows that share a doc_id, or have none, can be split over ranges too, by a hash of their ids.
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("ids"), F.col("ids")]
    dealt = ids.repartitionByRange(*order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    sums = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row per range
    first.coalesce(1).write.parquet(f"{path}/ranges")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files."""
    table = spark.read.schema("id int, frequency int").parquet(f"{path}/frequencies").collect()  # a row per id
    f = np.zeros(max((r["id"] for r in table), default=0) + 1, np.uint32)
    for r in table:
        f[r["id"]] = r["frequency"]
    known = spark.sparkContext.broadcast(f)
    extra = ", ids binary" if with_ids else ""

    def run(batches):
        freq = known.value.astype(np.uint64)
        start = (np.cumsum(freq) - freq).astype(np.uint64)
        symbol_of = np.repeat(np.arange(len(known.value), dtype=id_type(len(known.value))), known.value)
        for b in batches:
            for r in b.to_pylist():
                ids = rans_decode(r["n_tokens"], np.frombuffer(r["states"], "<u8"), np.frombuffer(r["words"], "<u4"), freq, start, symbol_of).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["crc32"]:
                    raise ValueError(f"block {r['part']}/{r['block']} has a wrong checksum")
                lens = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(lens)
                begins = ends - lens
                raw = [ids[a:e].tobytes() for a, e in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["offset"] + r["first"]), pa.array(lens), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ranges = spark.read.schema("part int, first long").parquet(f"{path}/ranges")
    return blocks.join(ranges, "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, ids_crc32 long{extra}")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files into a new folder of the shared one and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
