"""Parquet tables of a data folder, read by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``. Only Spark's reader touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
