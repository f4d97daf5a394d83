"""Gaps and islands of integer sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, key: str, value: str) -> DataFrame:
    own = df.select(key, value).distinct()
    return own.withColumn("island", F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value)))


def compress_ranges(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, range_start, range_end, n): the runs of consecutive distinct values."""
    runs = _islands(df, key, value).groupBy(key, "island")
    return runs.agg(F.min(value).alias("range_start"), F.max(value).alias("range_end"), F.count("*").alias("n")).drop("island")


def highest_contiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, highest): the end of the run from 1 on, else 0."""
    own = _islands(df.where(F.col(value) >= 1), key, value)
    return own.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("island") == 0, F.col(value))), F.lit(0)).cast("bigint").alias("highest"))
