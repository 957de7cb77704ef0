"""Sinks: metric tables, report sets, run metadata, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import missing_keys


def write_partitioned(df: DataFrame, path: str, by=("threshold", "model"), mode="overwrite") -> None:
    """Parquet, one directory per key. Every task writes its own rows, so a key
    with most of the rows is written by many tasks."""
    df.write.mode(mode).partitionBy(*[b for b in by if b in df.columns]).parquet(path)


def write_small_csv(df: DataFrame, path: str, mode="overwrite", max_rows=100_000) -> None:
    """One CSV file with header, for reports of a few rows per model. A table
    of more than ``max_rows`` rows is refused: it would go through one task."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: write a partitioned table instead")
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_report(tables: dict, path: str, mode="overwrite") -> None:
    """One parquet table per report sheet, under its name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def run_metadata(wanted: DataFrame, present: DataFrame, params: dict, keys=("slide_id",)) -> DataFrame:
    """One row: parameters and how many wanted ids are present or missing."""
    w = wanted.select(*keys).distinct()
    flag = present.select(*keys).distinct().withColumn("_p", F.lit(1))
    counts = w.join(flag, list(keys), "left").agg(
        F.count(F.lit(1)).alias("n_wanted"), F.count("_p").alias("n_present"))
    return counts.select("*", (F.col("n_wanted") - F.col("n_present")).alias("n_missing"), *[F.lit(v).alias(k) for k, v in params.items()])


def write_run_metadata(wanted: DataFrame, present: DataFrame, params: dict, path: str, keys=("slide_id",)) -> None:
    run_metadata(wanted, present, params, keys).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    missing_keys(wanted, present, keys).select(F.concat_ws("\t", *keys).alias("value")).write.mode("overwrite").text(f"{path}/missing")


def pending(todo: DataFrame, existing: DataFrame | None, keys, force=False) -> DataFrame:
    """Work whose output does not exist yet. Labels are mapped by the caller
    once, on the way in, never on what was read back."""
    return todo if force or existing is None else todo.join(existing.select(*keys), list(keys), "left_anti")


def resume(spark: SparkSession, todo: DataFrame, path: str, keys, compute, force=False) -> DataFrame:
    """Compute what is missing under ``path``, append it, return everything."""
    try:
        existing = None if force else spark.read.parquet(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = None
    compute(pending(todo, existing, keys, force)).write.mode("overwrite" if force else "append").parquet(path)
    return spark.read.parquet(path)
