"""Byte-level BPE as a monoid: texts are halved, halves encoded, neighbours joined.

A text longer than a leaf is cut in the middle and both halves are encoded by themselves. Joining re-encodes
a window around the cut. The window grows until both of its ends are places where the pattern starts a new
match whatever stands around them: a white-space character after one that is none, since no alternative of
the pattern goes from the one to the other. Left of the window nothing looks past its start, right of it
matching starts afresh, so tokens outside are those of the whole text. Decoding concatenates up the tree.

Nulls: a null text is empty, and an empty text has no tokens. Very long texts, also without any white space,
are encoded whole (then the window grows to the whole text). Other columns do not matter, repeated rows each
come out, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces as pieces_of

LEAF = 4096
SPACES = " \n\t\r"


@lru_cache(maxsize=2)
def codec(path: str):
    """(encoding, bytes of each token, their lengths); once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, pieces, np.array([len(p) for p in pieces], np.int64)


def is_start(text: str, i: int) -> bool:
    """Whether a match of the pattern starts at i in any text that holds these two characters."""
    return text[i] in SPACES and not text[i - 1].isspace()


def tokens_of_tail(ids: np.ndarray, n_bytes: int, lengths: np.ndarray, from_end: bool) -> int:
    """How many tokens at one end make up n_bytes; -1 if no token border lies there."""
    if n_bytes == 0:
        return 0
    some = ids[::-1][:n_bytes] if from_end else ids[:n_bytes]
    total = np.cumsum(lengths[some])
    at = int(np.searchsorted(total, n_bytes))
    return at + 1 if at < len(total) and total[at] == n_bytes else -1


def join(text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray, encode, lengths) -> np.ndarray:
    """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
    width = 64
    while True:
        a = next((i for i in range(mid - 1, max(lo, mid - width), -1) if is_start(text, i)), lo if mid - width <= lo else -1)
        b = next((i for i in range(mid + 1, min(hi, mid + width)) if is_start(text, i)), hi if mid + width >= hi else -1)
        if a >= 0 and b >= 0:
            drop = tokens_of_tail(left, len(text[a:mid].encode()), lengths, True)
            skip = tokens_of_tail(right, len(text[mid:b].encode()), lengths, False)
            if drop >= 0 and skip >= 0:
                return np.concatenate([left[: len(left) - drop], encode(text[a:b]), right[skip:]])
        width *= 4


def encode_tree(text: str, encode, lengths, leaf: int = LEAF) -> np.ndarray:
    def part(lo: int, hi: int) -> np.ndarray:
        if hi - lo <= leaf:
            return encode(text[lo:hi])
        mid = (lo + hi) // 2
        return join(text, lo, mid, hi, part(lo, mid), part(mid, hi), encode, lengths)

    return part(0, len(text))


def decode_tree(ids: np.ndarray, pieces: list, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return b"".join([pieces[i] for i in ids.tolist()])
    mid = len(ids) // 2
    return decode_tree(ids[:mid], pieces, leaf) + decode_tree(ids[mid:], pieces, leaf)


def encoded(docs: DataFrame, path: str, with_ids: bool = True, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32, if asked for), ids_sha256 (of the decimal ids joined
    by commas), decoded_sha256 (of the bytes that the ids decode to)."""
    ids_field = ", ids binary" if with_ids else ""

    def run(batches):
        encoding, pieces, lengths = codec(path)
        encode = lambda s: np.array(encoding.encode_ordinary(s), np.uint32)
        names = [str(i) for i in range(len(pieces))]
        for b in pieces_of(batches):
            n, raw, sha, back = [], [], [], []
            for t in b.column("text"):
                ids = encode_tree(t.as_py() or "", encode, lengths, leaf)
                n.append(len(ids))
                raw.append(ids.astype("<u4").tobytes() if with_ids else None)
                sha.append(hashlib.sha256(",".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
                back.append(hashlib.sha256(decode_tree(ids, pieces)).hexdigest())
            arrays = [b.column("doc_id"), pa.array(n, pa.int64())] + [pa.array(raw, pa.binary())] * with_ids + [pa.array(sha), pa.array(back)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_tokens long{ids_field}, ids_sha256 string, decoded_sha256 string")
