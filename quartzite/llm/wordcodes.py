"""Words of many texts at once, over the bytes of an Arrow column, and blocks of rows of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20


def blocks(batches, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Rows in blocks of at most `limit` bytes of `text` (one row, if that alone is longer)."""
    held, size = [], 0
    for b in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), np.int64)
        lo = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                if i > lo:
                    held.append(b.slice(lo, i - lo))
                yield pa.Table.from_batches(held)
                held, size, lo = [], 0, i
            size += int(n)
        if lo < b.num_rows:
            held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def word_codes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes int32 of all words in order, where each text's words begin and, last, their number, the words by
    code as binary). Words are runs of anything but ASCII white space; a null text has none."""
    col = pc.fill_null(texts.cast(pa.large_binary()), b"").combine_chunks()
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = ~WHITE[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    full = at[:-1] < at[1:]
    first[at[:-1][full]] = letter[at[:-1][full]]
    last[at[1:][full] - 1] = letter[at[1:][full] - 1]
    starts = np.flatnonzero(first)
    offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts))
    letters = data[letter]
    del first, last, letter
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices), np.searchsorted(starts, at), coded.dictionary
