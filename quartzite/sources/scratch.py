"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths given out in this process and not cleared yet.
_given: list[str] = []
#: Tables of the session's catalogue whose files lie under such paths.
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset: a temporary one, but only where driver and
    executors are one process; elsewhere it is an error, since other machines could not read it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quartzite.shared.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='quartzite-')}"
    spark.conf.set("quartzite.shared.dir", made)
    return made


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    _given.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _given[-1]


def scratch_table(name: str) -> None:
    """A table that `clear` is to drop with its files."""
    _tables.append(name)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back: lineage ends here (a lost executor costs only its running tasks)
    and Catalyst knows the size, by which it picks broadcast or shuffled joins itself."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete what was written under paths given out so far, and say how many there were. Results that still read
    them must have been saved or collected before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    n = len(_given)
    while _given:
        path = jvm.org.apache.hadoop.fs.Path(_given.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
