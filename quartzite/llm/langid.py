"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover every labelled row that may be learned from. The weights are fitted on a bounded
sample of those rows (max_rows, by a hash of doc_id and text), and the languages learned are the sample's: it is
dealt into shards, each runs follow-the-regularised-leader with elastic-net penalties, and the shards' weights
are averaged. A second bounded sample (max_calibration_rows), of rows that the weights have not seen, sets the
temperature of the softmax. Both are cut from the table in one pass and written. Prediction reads whole texts
and nothing but the text.

Nulls: a null text, or one without a letter of any script, is "und" with score 0; rows with a null lang or text
teach nothing; with nothing to learn from, all rows are "und". Repeated rows each come out; an empty table gives no
rows. Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, settled

BUCKETS = 1 << 16
UNKNOWN = "und"
LETTERS = r"\p{L}"

_letters = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's 1-, 2- and 3-grams, lower case, other characters than letters as one
    kind of gap; both empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ok = letter_table()[points]
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points[~ok] = 32
    a, b, c = (points * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    h = np.concatenate([a, a[:-1] + b[1:] + np.uint32(0x27D4EB2F), a[:-2] + b[1:-1] + c[2:] + np.uint32(0x165667B1)])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(h >> np.uint32(16), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = grams(text)
    v = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, (v / norm if norm > 0 else v)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2, one weight row per language."""

    def __init__(self, langs: int, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-3):
        self.z, self.n = np.zeros((langs, BUCKETS + 1)), np.zeros((langs, BUCKETS + 1))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[:, at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(self.n[:, at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        at, v = np.append(at, BUCKETS), np.append(v, 1.0)
        w = self.weights(at)
        s = w @ v
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = p[:, None] * v[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


class Model:
    def __init__(self, langs: list, idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def logits(self, text: str) -> np.ndarray | None:
        at, v = tf_idf(text, self.idf)
        return self.weights[:, at] @ v + self.weights[:, BUCKETS] if len(at) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        s = self.logits(text) if text and self.langs else None
        if s is None:
            return UNKNOWN, 0.0
        p = np.exp((s - s.max()) / self.temperature)
        return self.langs[int(s.argmax())], float(p.max() / p.sum())


def remainder(doc_id=None):
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 4


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the rows hold each bucket, and how many rows there are: partial counts in the tasks, then
    one row per bucket."""

    def part(batches):
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t in b.column("text"):
                at, _ = grams(t.as_py())
                df[at] += 1
                df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["at", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    got = rows.select("text").mapInArrow(part, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


def samples(rows: DataFrame, n: int, max_rows: int, max_calibration_rows: int) -> DataFrame:
    """(text, lang, h, fit): about max_rows rows to fit and max_calibration_rows to calibrate, of those whose
    remainder is 3; the same on each run, by a hash. n: how many rows there are."""
    h = F.xxhash64("doc_id", "text")
    place = F.pmod(F.xxhash64(F.lit("sample"), h), F.lit(1 << 30)) / float(1 << 30)
    fit = F.col("r").isNull() | (F.col("r") != 3)
    share = F.when(fit, max_rows / max(1, n * 2 // 3)).otherwise(max_calibration_rows / max(1, n // 3))
    return rows.select("text", "lang", h.alias("h"), fit.alias("fit")).filter(place < share)


def train(docs: DataFrame, max_rows: int = 16_000, max_calibration_rows: int = 4_000, shard_rows: int = 2_000, epochs: int = 3) -> Model:
    spark = docs.sparkSession
    usable = docs.select("doc_id", "text", "lang", remainder().alias("r")).filter("text is not null and lang is not null and (r is null or r != 2)")
    df, n = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = settled(samples(usable, n, max_rows, max_calibration_rows), "language-sample")
    known = sample.filter("fit").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # at most max_rows rows
    langs, rows = [r["lang"] for r in known], sum(r["n"] for r in known)
    if not langs:
        return Model([], idf, np.zeros((0, BUCKETS + 1)))
    number = {x: i for i, x in enumerate(langs)}
    shards = max(1, rows // shard_rows)
    know = spark.sparkContext.broadcast(idf)

    def shard(batches):
        learner, rows = Ftrl(len(langs)), []
        for pdf in batches:
            rows += [(i, *tf_idf(t, know.value), number[x]) for i, t, x in zip(pdf.h, pdf.text, pdf.lang)]
        rows.sort(key=lambda r: r[0])
        for _ in range(epochs):
            for _, at, v, y in rows:
                if len(at):
                    learner.learn(at, v, y)
        w = learner.weights(np.arange(BUCKETS + 1))
        i, at = np.nonzero(w)
        yield pd.DataFrame({"lang": i, "at": at, "w": w[i, at] * len(rows)})

    dealt = sample.filter("fit").select("text", "lang", "h").repartition(shards, "h")
    weights = dealt.mapInPandas(shard, "lang int, at int, w double").groupBy("lang", "at").agg(F.sum("w").alias("w")).toPandas()  # at most langs x buckets
    w = np.zeros((len(langs), BUCKETS + 1))
    w[weights["lang"].to_numpy(np.int64), weights["at"].to_numpy(np.int64)] = weights["w"].to_numpy() / rows
    model = Model(langs, idf, w)
    model.temperature = temperature(sample.filter("not fit"), model)
    return model


def temperature(rows: DataFrame, model: Model) -> float:
    """The temperature of least log loss on labelled rows; one row of scores per row, a bounded number."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for pdf in batches:
            got = [(known.value.logits(t), x) for t, x in zip(pdf.text, pdf.lang) if x in known.value.langs]
            got = [(list(s), known.value.langs.index(x)) for s, x in got if s is not None]
            yield pd.DataFrame({"s": [s for s, _ in got], "y": [y for _, y in got]})

    got = rows.select("text", "lang").mapInPandas(score, "s array<double>, y int").toPandas()
    if not len(got):
        return 1.0
    s, y = np.stack(got["s"].to_numpy()), got["y"].to_numpy()

    def loss(t: float) -> float:
        x = s / t
        top = x.max(1)
        return float((top + np.log(np.exp(x - top[:, None]).sum(1)) - x[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 5, 81), key=loss)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns, then lang_pred and score."""
    return packed_predictions(docs.select(F.struct(*keep).alias("d"), F.col("text").alias("text")), model).select("d.*", "lang_pred", "score")


def packed_predictions(rows: DataFrame, model: Model) -> DataFrame:
    """(d, lang_pred, score) of rows (d, text): d is any column, packed so that nothing in it can clash."""
    known = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select("d").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for b in pieces(batches):
            got = [known.value.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["d", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
