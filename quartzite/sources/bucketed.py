"""Tables kept in buckets of a join's keys: written once, then joined bucket by bucket without an exchange."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import scratch_path, scratch_table, stored


@dataclass
class Bucketed:
    """rows: the table in buckets. apart: rows whose key would fill a bucket alone, and rows with a null in their key.
    hot: those keys, fewer than there are buckets."""

    rows: DataFrame
    apart: DataFrame
    hot: DataFrame
    keys: list
    buckets: int
    unique: bool


def buckets_for(rows: int, bucket_rows: int = 2_000_000) -> int:
    """A power of two, so that tables of different sizes can still be joined without an exchange."""
    n = 8
    while n * bucket_rows < rows:
        n *= 2
    return n


def bucketed(df: DataFrame, tag: str, keys: list, buckets: int, unique: bool = False) -> Bucketed:
    """Write df in buckets of its keys, sorted in each. A key with more than an even share of the rows stays out of the
    buckets, in files of any size, so that no task writes or reads such a key alone.

    unique: at most one row a key is expected; more is an error. Null keys, empty tables, repeated rows and further
    columns are kept as they are."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    counts = stored(df.filter(complete).groupBy(*keys).agg(F.count("*").alias("__n")), f"{tag}-counts")
    total, most = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    if unique and most > 1:
        raise ValueError(f"{tag}: keys repeat")
    share = max(1, -(-total // buckets))
    hot = stored(counts.filter(F.col("__n") > share).select(*keys), f"{tag}-hot")
    few = F.broadcast(hot)  # fewer keys than buckets have more than an even share
    cold = df.filter(complete).join(few, keys, "left_anti").select(*df.columns)
    apart = df.filter(~complete).unionByName(df.filter(complete).join(few, keys, "left_semi").select(*df.columns))
    name = f"quartzite_{uuid.uuid4().hex}"
    scratch_table(name)
    cold.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", scratch_path(df.sparkSession, tag)).saveAsTable(name)
    return Bucketed(df.sparkSession.table(name), stored(apart, f"{tag}-apart"), hot, list(keys), buckets, unique)


def joined(left: Bucketed, rights: list, how: str = "left") -> DataFrame:
    """Equal joins (inner, left, left_semi, left_anti), one after another, with tables of unique keys. Buckets meet
    buckets; rows apart meet the right sides' rows of the hot keys, one a key. A null in a key matches nothing."""
    if any(left.keys != r.keys or left.buckets != r.buckets or not r.unique for r in rights):
        raise ValueError("all sides need the same keys and buckets, and the right sides unique keys")
    met, apart = left.rows, left.apart
    for r in rights:
        met = met.join(r.rows, left.keys, how)
        answers = r.rows.join(F.broadcast(left.hot), left.keys, "left_semi")
        apart = apart.join(F.broadcast(answers), left.keys, how)  # at most one row a hot key
    return met.unionByName(apart)
