"""Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the folder's tables; only Spark's reader touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
