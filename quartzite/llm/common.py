"""What the operators share: reading a table, and tables written in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, shared_dir, stored

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch, on both sides of a Python worker, where rows hold whole texts.
BATCH_ROWS = 2000
#: Rows that a Python function turns into one batch of results.
PIECE_ROWS = 500


def wide_rows(spark: SparkSession) -> None:
    """Texts are wide rows: lower the session's rows per Arrow batch, if it allows more, so that a batch
    stays a few MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def pieces(batches):
    """Arrow batches cut to PIECE_ROWS rows, without copies."""
    for b in batches:
        for lo in range(0, b.num_rows, PIECE_ROWS):
            yield b.slice(lo, PIECE_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    wide_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A new path in the shared folder, and a table written there and read back; scratch.clear() deletes them.
new_path, settled = scratch_path, stored


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def n_words(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>): rows whose id is not null and whose vector is not null, not empty, and
    holds only finite numbers, of any length. Equal rows count once."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite).dropDuplicates(["vec_id", "vec"])


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """rows joined with `few`, which has one row per key and, as n, how many of `rows` have that key. Of keys with more
    than one in `share` of all rows there are fewer than `share`, so their rows of `few` are broadcast and no task
    gets such a key whole; the others are joined by key. Rows without a match go. Write both tables first: they are
    read twice."""
    total = few.agg(F.sum(n)).first()[0] or 0
    values = [c for c in few.columns if c not in (*keys, n)]
    hot = few.filter(F.col(n) * share > total).select(*keys, F.struct(*values).alias("hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    wide = marked.filter("hot is not null").select(*rows.columns, *[F.col("hot")[c].alias(c) for c in values])
    rest = few.filter(F.col(n) * share <= total).select(*keys, *values)
    return wide.unionByName(marked.filter("hot is null").drop("hot").join(rest, keys).select(*rows.columns, *values))
