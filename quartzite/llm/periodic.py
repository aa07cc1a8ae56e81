"""Runs of words that repeat with a period, found by minimizers at several scales.

A run is a stretch of words with smallest period q, at least 24 words and 3 periods long, that no neighbouring
word extends. Short periods are scanned: for each lag, words equal to the word one lag on. For longer ones the
scales' k-word hashes grow by half; scale k finds the periods in (2k/3, k]. Of each window of k/3 hashes the
smallest is chosen. Inside a run the windows one period on hold the same words, so the choice repeats at just that
distance; between the two there is no equal k-word piece, since pieces of a period and more repeat only
at its multiples. So each chosen hash and the next chosen one equal to it are the only pairs to try. A pair is
extended to both sides word by word (in chunks), and what is long enough and has no smaller period is a run.

Nothing rests on hashes being unique: if a pair of equal hashes turns out to be of different words, the block
is searched again with other hashes.

Texts are taken in blocks of rows, longest first, with a word of its own after each, which no run can cross, so short texts cost no
more per word than long ones. Memory grows with the block's words (a longer text is alone in its block).

Nulls: a null text has no words. A null doc_id is kept, and its text is never rewritten. Repeated rows each come
out. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcodes import blocks, word_codes

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Periods up to this one are scanned by lag.
SCANNED = 16
BLOCK_BYTES = 4 << 20


def least_length(period: int) -> int:
    return max(MIN_LENGTH, MIN_PERIODS * period)


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True."""
    edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def primitive(codes: np.ndarray, start: int, length: int, period: int) -> bool:
    """No smaller period. As the stretch is two periods and longer, a smaller one divides it."""
    divisors = [period // f for f in range(2, period + 1) if period % f == 0 and all(f % g for g in range(2, int(f**0.5) + 1))]
    return not any(np.array_equal(codes[start : start + length - d], codes[start + d : start + length]) for d in divisors)


def scan(codes: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    """Runs of one period, by comparing all words with those one period on."""
    if len(codes) < least_length(period):
        return []
    begin, end = stretches(codes[:-period] == codes[period:])
    long = end - begin + period >= least_length(period)
    return [(int(b), int(e - b) + period, period) for b, e in zip(begin[long], end[long]) if primitive(codes, b, int(e - b) + period, period)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two pieces one after the other."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w in a row: running minima from block borders to both sides."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def minimizers(x: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the smallest of some window of w, ties all."""
    if len(x) < w:
        return np.zeros(0, np.int64)
    least = window_minima(x, w)
    # The largest minimum of the windows that hold a position: it is chosen if that is its own value.
    padded = np.concatenate([np.full(w - 1, np.iinfo(np.uint64).max, np.uint64), ~least, np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)])
    return np.flatnonzero(~window_minima(padded, w) == x)


class Collision(Exception):
    """Two different pieces have one hash."""


def same_until(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the equal beginning of two sequences, read in growing chunks."""
    n, at, chunk = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : at + chunk][: n - at] != b[at : at + chunk][: n - at]
        if differ.any():
            return at + int(differ.argmax())
        at, chunk = min(n, at + chunk), chunk * 2
    return n


def extended(codes: np.ndarray, x: np.ndarray, chosen: np.ndarray, k: int, least: int) -> list[tuple[int, int, int]]:
    """Runs around pairs of next equal minimizers at a distance over `least` and up to k. Nearer pairs are only
    checked: of different words, one might hide a pair that counts."""
    order = np.argsort(x[chosen], kind="stable")
    at, h = chosen[order], x[chosen][order]
    lag = np.diff(at)
    equal = (h[1:] == h[:-1]) & (lag <= k)
    for part in np.array_split(np.flatnonzero(equal & (lag <= least)), max(1, np.count_nonzero(equal) * k >> 20)):
        here = at[part][:, None] + np.arange(k)
        if (codes[here] != codes[here + lag[part][:, None]]).any():
            raise Collision
    pair = np.flatnonzero(equal & (lag > least))
    seeds, lags = at[pair], lag[pair]
    order = np.lexsort((seeds, lags))
    out, covered, last = [], -1, 0
    for i, d in zip(seeds[order].tolist(), lags[order].tolist()):
        if d == last and i < covered:
            continue
        ahead = same_until(codes[i:], codes[i + d :])
        if ahead < k:
            raise Collision
        back = same_until(codes[:i][::-1], codes[d : i + d][::-1])
        last, covered = d, i + ahead
        start, length = i - back, back + ahead + d
        if length >= least_length(d) and primitive(codes, start, length, d):
            out.append((start, length, d))
    return out


def runs_of(codes: np.ndarray, starts: np.ndarray, seed: int = 0) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts laid end to end, longest text first, each followed by a word
    that occurs once. starts: where each text begins and, last, where the whole ends."""
    codes = np.ascontiguousarray(codes)
    sizes = np.diff(starts) - 1
    longest = int(sizes.max(initial=0))
    out = [r for q in range(1, min(SCANNED, longest // MIN_PERIODS) + 1) for r in scan(codes, q)]
    with np.errstate(over="ignore"):
        power, x = 1, mix(codes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D * (2 * seed + 1) % 2**64))
        low = SCANNED
        while MIN_PERIODS * (low + 1) <= longest:
            k = low + low // 2
            end = int(starts[np.count_nonzero(sizes >= MIN_PERIODS * (low + 1))])  # only texts that can hold such a run
            x = x[: max(end, 1)]
            while 2 * power <= k:
                x = joined(x[:-power], x[power:])
                power *= 2
            rest = k - power
            whole = x if not rest else joined(x[:-rest], x[rest:])
            # Windows of w pieces of k words, and one period more, fit in three periods.
            w = max(1, 2 * (low + 1) - k + 1)
            try:
                out += extended(codes[:end], whole, minimizers(whole, w), k, low)
            except Collision:
                return runs_of(codes, starts, seed + 1)
            low = k
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def rewritten(codes: np.ndarray, doc_id: int | None) -> np.ndarray | None:
    """Positions of the words that a planted repetition puts in place of a text's words; None if it is left as it is."""
    n = len(codes)
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def plant(codes: np.ndarray, starts: np.ndarray, ids: list) -> np.ndarray:
    codes = codes.copy()
    for i, doc_id in enumerate(ids):
        own = codes[starts[i] : starts[i + 1]]
        at = rewritten(own, doc_id)
        if at is not None:
            codes[starts[i] : starts[i + 1]] = own[at]
    return codes


def block_runs(codes: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its runs as (start, length, period), counted from its own first word."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order] + 1)
    begins = np.append(ends - sizes[order] - 1, ends[-1:])
    laid = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    laid[ends - 1] = int(codes.max(initial=0)) + 1 + np.arange(len(ends))
    inside = np.ones(len(laid), bool)
    inside[ends - 1] = False
    shift = np.repeat(starts[:-1][order] - begins[:-1], sizes[order])
    laid[inside] = codes[np.flatnonzero(inside) + shift]
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for start, length, period in runs_of(laid, begins) if len(laid) else []:
        i = int(np.searchsorted(begins, start, "right")) - 1
        out[order[i]].append((start - int(begins[i]), length, period))
    return out


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, planted: bool = False, limit: int = BLOCK_BYTES, with_runs: bool = True) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (start, length, period, exponent_milli), digests of all runs
    and of the text without repeated periods, and the runs. planted: rewrite a tenth of the texts first, as
    `rewritten` says, so that there is something to find."""

    def run(batches):
        for b in blocks(batches, limit):
            ids = b.column("doc_id").to_pylist()
            codes, starts, words = word_codes(b.column("text"))
            if planted:
                codes = plant(codes, starts, ids)
            found, words = block_runs(codes, starts), words.to_pylist()
            rows = []
            for i, doc_id in enumerate(ids):
                own, runs = codes[starts[i] : starts[i + 1]], found[i]
                if runs:
                    steps = np.zeros(len(own) + 1, np.int64)
                    for start, length, period in runs:
                        steps[start + period] += 1
                        steps[start + length] -= 1
                    own = own[np.cumsum(steps)[:-1] == 0]
                    best = runs[0]
                    for r in runs[1:]:
                        ahead = r[1] * best[2] - best[1] * r[2]
                        if ahead > 0 or (ahead == 0 and (r[0], r[2]) < (best[0], best[2])):
                            best = r
                    top = [*best, 1000 * best[1] // best[2]]
                else:
                    top = [None] * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                text = b" ".join([words[c] for c in own.tolist()])
                rows.append([doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), runs if with_runs else None])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    s, t = pa.int64(), pa.string()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [s, s, s, s, s, s, t, t, pa.list_(pa.struct([("start", s), ("length", s), ("period", s)]))]
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return found if with_runs else found.drop("runs")
