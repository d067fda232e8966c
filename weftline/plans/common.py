"""Tables of a scale-factor folder, and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.kept import kept, shared_folder

__all__ = ["keeper", "kept", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keeper(spark: SparkSession, what: str):
    """A function that writes a table to the shared folder and reads it back, which cuts lineage."""
    return lambda df: kept(df, what)
