"""Paths in the folder that all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or (only where that is unset and the master is local, as in tests) under a
    temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_series_dir", None)
        if at is None:
            at = spark.sparkContext._series_dir = "file://" + tempfile.mkdtemp(prefix="series-")
    return f"{at.rstrip('/')}/series/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and reread: what is read several times is computed once, and survives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
