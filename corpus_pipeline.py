"""A corpus pipeline: language, lines, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import bpe, langid, linededup, mixing, nearcopies
from quartzite.llm.common import settled, table, wide_rows
from quartzite.llm.queries import BYTE_BPE, MIN_SITES, vocabulary

#: Below this calibrated score a text is in none of the learned languages. Short texts in a known language
#: score little more than chance, so only what is hardly above chance goes.
MIN_SCORE = 0.3

#: Texts with this Jaccard similarity or more, on shingles of so many words, are near copies.
SHINGLE, SIMILAR = 5, 0.8

#: Sites from which a long line that stands in several texts is repeated; shorter ones need MIN_SITES.
LONG_SITES = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go. Where nothing can be learned (no labelled text),
    every text with a letter stays, since none can be told to be in another language. Repeated rows are judged
    alike; an empty table stays empty."""
    wide_rows(spark)
    model = langid.train(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(langid.LETTERS))
    found = langid.packed_predictions(docs.select(F.struct(*docs.columns).alias("d"), F.col("text").alias("text")), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("d.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sources, and passages of several texts on two or more, stay in the first document
    that has them; n_chars follows the text. A null text stays null and has no line; a null source counts as one source; of
    repeated rows the first keeps a spread line. An empty table stays empty."""
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("d.n_chars"))}
    return linededup.cleaned(docs, MIN_SITES, LONG_SITES).select(*[(changed[c] if c in changed else F.col("d")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that share at least SIMILAR of their SHINGLE-word shingles form groups; texts without a word are one.
    Of each group the document with the smallest doc_id stays (one without an id only if none has one), of documents
    that share that id the one with the smallest hash of its text, and of repeated rows one, by a hash of the row.
    An empty table stays empty."""
    wide_rows(spark)
    roots = nearcopies.near_copies(docs, SHINGLE, SIMILAR)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("node"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("first")
    kept = settled(rows.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(first).select("first.id", "first.node"), "pipeline-kept")
    d = F.struct(*[F.col(c).alias(c) for c in docs.columns])
    packed = docs.select(d.alias("d"), F.col("doc_id").cast("long").alias("of"), F.xxhash64("text").alias("tag"), F.xxhash64(*docs.columns).alias("place"))
    named = packed.join(kept, F.col("of").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("node")), "left_semi")
    return named.groupBy("of", "tag").agg(F.min_by("d", "place").alias("d")).select("d.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, by whole documents, repeated where a target asks for it. A null source is one of its
    own, the last; a null or empty text has no words and adds nothing to a mixture, so it goes. Repeated rows share a place
    and go the same way. An empty table stays empty."""
    _, plan = mixing.mixed(docs)
    return mixing.whole_documents(docs, plan)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256. A null text is empty; repeated rows each come out; very long texts
    are encoded whole. An empty table stays empty."""
    wide_rows(spark)
    return bpe.encoded(docs, vocabulary(BYTE_BPE))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: The first stage is a trained model, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
