"""Typed readers and writers for the library's file formats. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import REASON_COUNTERS

#: The case tables name their density column in one of these ways.
DENSITY_COLUMNS = ("breast density", "breast_density", "density")


def write_case_files(cases: DataFrame, path: str) -> list[tuple[int, str, str]]:
    """Four CSV folders, one per file_ord, each with its own name for the density column."""
    out = []
    for k in range(4):
        name = DENSITY_COLUMNS[k % 3]
        part = cases.filter(F.col("file_ord") == k).select("patient_id", F.col("side").alias("left or right breast"), F.col("view_raw").alias("image view"), F.col("density_code").alias(name), "row_ord")
        part.write.csv(f"{path}/{k}", header=True)
        out.append((k, f"{path}/{k}", name))
    return out


def case_tables(spark: SparkSession, files: list[tuple[int, str, str]]) -> DataFrame:
    """The case files as one table; density from the first of its three columns that is not blank."""
    parts = []
    for k, path, name in files:
        schema = T.StructType()
        for c in ("patient_id", "left or right breast", "image view", name):
            schema.add(c, "string")
        parts.append(spark.read.csv(path, schema=schema.add("row_ord", "long"), header=True).withColumn("file_ord", F.lit(k)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    have = [c for c in DENSITY_COLUMNS if c in every.columns]
    density = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in have])
    return every.select(F.trim("patient_id").alias("patient_id"), F.trim("`left or right breast`").alias("side"), F.trim("`image view`").alias("view_raw"), density.alias("density_code"), "file_ord", "row_ord")


def series_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="modality string, series_description string, series_id string, image_path string, row_ord long", header=True)


def clean_metadata(spark: SparkSession, path: str, schema: T.StructType, need: tuple) -> DataFrame:
    """Fails while planning if a needed column is not in the schema or the file's header."""
    missing = [c for c in need if c not in schema.names]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Reject lines that name a file; early rejects lack most columns."""
    return spark.read.json(path, schema="row_ord long, file_name string, reason string").filter(F.coalesce("file_name", F.lit("")) != "")


def lenient_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blank and broken lines are skipped; the key is the first of three names."""
    rows = spark.read.json(path, schema="file_name string, filename string, image string, score double", mode="DROPMALFORMED")
    return rows.select(F.coalesce("file_name", "filename", "image").alias("key"), "score").filter("key is not null")


def source_map(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("generated", "source"))


def observed_split(status: DataFrame) -> tuple[DataFrame, Observation]:
    """Status rows as they are written, side 'kept' or 'rejected' with reasons as one text, and the counters that their write
    fills: kept, missing_* and reject_*. They are counted behind the shuffle, in the tasks that write, so a
    lost executor's rows are not counted twice; nothing is scanned again or kept for counting."""
    kept = F.size("reasons") == 0
    counters = {"kept": F.count_if(kept)} | {c: F.count_if(F.array_contains("reasons", r)) for c, r in REASON_COUNTERS.items()}
    rows = status.withColumn("side", F.when(kept, "kept").otherwise("rejected")).repartition("side", "view", "density", F.col("row_ord") % 8)
    seen = Observation()
    return rows.observe(seen, *[n.alias(c) for c, n in counters.items()]).withColumn("reason", F.when(~kept, F.array_join("reasons", "|"))).drop("reasons"), seen


def write_split(status: DataFrame, path: str) -> tuple[str, str, dict[str, int]]:
    """Kept and rejected rows by view and density, in one write, and its counters."""
    rows, seen = observed_split(status)
    rows.write.partitionBy("side", "view", "density").parquet(path)
    return f"{path}/side=kept", f"{path}/side=rejected", {c: n for c, n in seen.get.items() if n}


def filter_view_density(rows: DataFrame, view_col: str, density_col: str, view: str | None, density: str | None, known: dict) -> DataFrame:
    """View in any case; a density filter that is not one of the known names filters nothing."""
    if view:
        rows = rows.filter(F.upper(view_col) == view.upper())
    if density and density.lower() in known:
        rows = rows.filter(F.lower(density_col) == density.lower())
    return rows


def filter_aspect(rows: DataFrame, most: float = 2.2) -> DataFrame:
    """Long over short side; without both columns nothing is filtered."""
    if not {"width", "height"} <= set(rows.columns):
        return rows
    ratio: Column = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1))
    return rows.filter(ratio <= most)
