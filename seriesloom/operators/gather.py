"""Training rows from found places: subsequences, labels, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import windows


def subsequences(series: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """places (sensor_id, start, any others) with x, the `length` values from start; places that don't fit go."""
    return places.join(windows(series, length).withColumnRenamed("c", "x"), ["sensor_id", "start"])


def values_at(series: DataFrame, places: DataFrame, offset, name: str = "y") -> DataFrame:
    """places with the value at start + offset (a number or a column); places beyond the end go."""
    at = (F.col("start") + offset).cast("long")
    return places.withColumn("t", at).join(series.select("sensor_id", "t", F.col("v").alias(name)), ["sensor_id", "t"]).drop("t")


def training_rows(series: DataFrame, found: DataFrame, horizon: int, length: Column | int | None = None) -> DataFrame:
    """found (with len) with y, the value `horizon` places after the place that follows the subsequence."""
    return values_at(series, found, (F.col("len") if length is None else length) + horizon)


def grouped(rows: DataFrame) -> DataFrame:
    """query_id, len, train: array of (rank, start, dist, y) in order of rank."""
    return rows.groupBy("query_id", "len").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "dist", "y"))).alias("train"))


def next_labels(series: DataFrame, found: DataFrame, step: int) -> DataFrame:
    """Labels of a later step of a multi-step forecast: the value `step` places after the subsequence."""
    return values_at(series, found, F.col("len") + step)
