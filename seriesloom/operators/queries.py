"""Query construction: sampled, sequential and latest queries, suffix items and alignment with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import lengths, windows


def sample_starts(series: DataFrame, length: int, number: int, variant: str = "inner") -> DataFrame:
    """sensor_id, i, start: evenly spaced starts. inner keeps `length` places free at both ends, plain doesn't."""
    n = lengths(series)
    if variant == "inner":
        stride, start = F.floor((F.col("n") - 2 * length - 1) / number), F.lit(length)
    else:
        stride, start = F.floor((F.col("n") - length) / number), F.lit(0)
    every = n.select("sensor_id", stride.alias("stride"), F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("i"))
    return every.select("sensor_id", "i", (F.col("i") * F.col("stride") + start).cast("long").alias("start"))


def cut_queries(series: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """sensor_id, start, q: the subsequence at each start. Places find their starts by a join on the start's block of
    `length` places, so windows that no query needs are never built."""
    s = starts.select("sensor_id", "start").distinct()
    near = s.select("sensor_id", "start", F.explode(F.array(F.floor(F.col("start") / length), F.floor(F.col("start") / length) + 1)).alias("b"))
    rows = series.withColumn("b", F.floor(F.col("t") / length)).join(near, ["sensor_id", "b"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + length))
    q = rows.groupBy("sensor_id", "start").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    return q.filter(F.size("p") == length).select("sensor_id", "start", F.transform("p", lambda x: x.v).alias("q"))


def sample_queries(series: DataFrame, length: int, number: int, variant: str = "inner") -> DataFrame:
    return cut_queries(series, sample_starts(series, length, number, variant), length)


def sequential_queries(series: DataFrame, first: int, count: int, length: int) -> DataFrame:
    """sensor_id, start, q for overlapping queries from `first` on."""
    starts = lengths(series).select("sensor_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))).alias("start"))
    return cut_queries(series, starts, length)


def latest(series: DataFrame, length: int, back: int = 0) -> DataFrame:
    """sensor_id, start, q: each sensor's last `length` values, ending `back` places before its end."""
    starts = lengths(series).select("sensor_id", (F.col("n") - length - back).alias("start"))
    return cut_queries(series, starts, length)


def items(queries: DataFrame, lengths_: list[int]) -> DataFrame:
    """One row per query and length, item holding the suffix of that length; all other columns stay."""
    return queries.select("*", F.explode(F.array(*(F.lit(x) for x in lengths_))).alias("len")).withColumn("item", F.expr("slice(q, size(q) - len + 1, len)"))


def group_items(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Results of items back in one row per query: array of (len, rank, start, dist), in that order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("len", "rank", "start", "dist"))).alias("results"))


def align_step(queries: DataFrame, step: int, longest: int, horizon: int) -> DataFrame:
    """x and y at a step: the query's values step .. step + longest - 1, and the value at step + longest + horizon."""
    ok = F.size("q") > step + longest + horizon
    return queries.filter(ok).select(*[c for c in queries.columns if c != "q"], F.slice("q", step + 1, longest).alias("x"), F.element_at("q", step + longest + horizon + 1).alias("y"))


def geometric_grid(length: int, k: int) -> tuple[list[int], list[int]]:
    """Four halving lengths and neighbour counts, ascending."""
    return [length >> (3 - i) for i in range(4)], [k >> (3 - i) for i in range(4)]


def training_set(series: DataFrame, dim: int, offset: int) -> DataFrame:
    """sensor_id, start, x (dim values) and y: the value `offset` places after the last one of x (offset 0: that one)."""
    if offset < 1:
        return windows(series, dim).select("sensor_id", "start", F.col("c").alias("x"), F.element_at("c", -1).alias("y"))
    return windows(series, dim, ahead=offset).withColumnRenamed("c", "x")
