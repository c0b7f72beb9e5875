"""Tables of a folder as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Each ``folder/name.parquet`` as the view ``name``, for ``spark.sql``."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """A statement over DataFrames named in it as ``{name}``."""
    return spark.sql(sql, **frames)
