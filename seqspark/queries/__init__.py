"""Queries over the test tables: each module has QUERIES (name to function of session and folder) and SQL (the same in DuckDB's dialect)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
