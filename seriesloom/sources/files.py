"""Readers and writers: series and matrices as CSV or text, query files, posting lists, supervised sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text data set without comment lines (those that hold a '#'), in file order by `line`."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).filter(~F.col("value").contains("#"))


def read_csv_column(spark: SparkSession, path: str, column: int, kind: str = "double") -> DataFrame:
    """line, value: one column (from 0) of a CSV without header, cast to int, double or float; comments are skipped."""
    return _lines(spark, path).select("line", F.trim(F.get(F.split("value", ","), F.lit(column))).cast(kind).alias("value"))


def read_matrix(spark: SparkSession, path: str, pattern: str = "[, ]+", kind: str = "double") -> DataFrame:
    """line, row array: every number of each line, separated by commas or spaces (or by another pattern)."""
    parts = F.filter(F.split(F.trim("value"), pattern), lambda x: x != "")
    return _lines(spark, path).select("line", F.transform(parts, lambda x: x.cast(kind)).alias("row"))


def read_columns_as_series(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """sensor (column number), line, value: columns first..last of a CSV, one series each."""
    m = read_matrix(spark, path, ",")
    picked = F.slice("row", first + 1, last - first + 1)
    return m.select("line", F.posexplode(picked).alias("i", "value")).select((F.col("i") + first).alias("sensor"), "line", "value")


def write_series_csv(series: DataFrame, path: str, columns: list[str]) -> None:
    series.select(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


def write_queries(queries: DataFrame, path: str, kind: str = "double") -> None:
    """One query (start, q array) per line, numbers separated by a space, ascending by start."""
    queries.orderBy("start").select(F.concat_ws(" ", F.transform("q", lambda x: x.cast(kind).cast("string"))).alias("value")).write.text(path)


def write_composite_queries(queries: DataFrame, path: str, bits: int) -> None:
    """As write_queries, each value as the key (place << bits) + value."""
    keyed = F.transform("q", lambda x, i: (F.shiftleft(i.cast("long"), bits) + x).cast("string"))
    queries.orderBy("start").select(F.concat_ws(" ", keyed).alias("value")).write.text(path)


def read_queries(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """line, q: one whitespace-separated vector per line."""
    return read_matrix(spark, path, r"\s+", kind).withColumnRenamed("row", "q")


def write_postings(postings: DataFrame, path: str) -> None:
    """Posting lists (dim, value, positions) as Parquet, one folder per dimension."""
    postings.write.partitionBy("dim").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_matrix(matrix: DataFrame, path: str, decimals: int) -> None:
    """line, row as CSV with fixed decimals, ascending by line."""
    text = F.transform("row", lambda x: F.regexp_replace(F.format_number(x, decimals), ",", ""))
    matrix.orderBy("line").select(F.concat_ws(",", text).alias("value")).write.text(path)


def file_names(holder: str, dim: int, n: int) -> dict[str, str]:
    """The naming convention of data, query and group-query files."""
    return {"data": f"{holder}.csv", "query": f"{holder}_d{dim}_q{n}_dir.query", "group": f"{holder}_ql{dim}_gqn{n}_group.query"}


def random_postings(spark: SparkSession, dims: int, values: int, entries: int, seed: int = 1) -> DataFrame:
    """Random posting rows (dim, value, pos), for tests of the inverted lists."""
    return spark.range(dims * entries).select((F.col("id") % dims).cast("int").alias("dim"), F.floor(F.rand(seed) * values).cast("int").alias("value"), F.floor(F.rand(seed + 1) * entries).cast("long").alias("pos"))
