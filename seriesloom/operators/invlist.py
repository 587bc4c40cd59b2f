"""Inverted lists over bucketed windows, and the bidirectional-expansion neighbour search on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..sources.storage import stored


def composite_key(dim: Column, value: Column, bits: int) -> Column:
    return F.shiftleft(dim.cast("long"), bits) + value


def split_key(key: Column, bits: int) -> tuple[Column, Column]:
    return F.shiftright(key, bits), key.bitwiseAND((1 << bits) - 1)


def postings(windows: DataFrame) -> DataFrame:
    """sensor_id, dim, value, pos rows of windows (sensor_id, start, c): one posting per place of every window."""
    return windows.select("sensor_id", F.col("start").alias("pos"), F.posexplode("c").alias("dim", "value"))


def disjoint_postings(bucketed: DataFrame, dims: int) -> DataFrame:
    """Postings of disjoint windows of (sensor_id, t, bucket): pos = t div dims, dim = t mod dims."""
    return bucketed.select("sensor_id", F.floor(F.col("t") / dims).alias("pos"), F.pmod("t", F.lit(dims)).cast("int").alias("dim"), F.col("bucket").alias("value"))


def lists(rows: DataFrame) -> DataFrame:
    """sensor_id, dim, value, n: how long each posting list is. Lists themselves stay rows, dealt by (dim, value), so a
    common value is never gathered."""
    return rows.groupBy("sensor_id", "dim", "value").agg(F.count("*").alias("n"))


def _known(df: DataFrame, name: str) -> DataFrame:
    """A table of queries or results, written so that the planner knows its size: a small one is sent to the postings, of
    which only counts are then shuffled; a large one is dealt out with them."""
    return stored(df, name)


def point_query(rows: DataFrame, queries: DataFrame, threshold: int) -> DataFrame:
    """query_id, sensor_id, pos, matches: entries that equal the query (query_id, sensor_id, dim, kw) in more than
    `threshold` dimensions."""
    hits = rows.join(_known(queries.withColumnRenamed("kw", "value"), "index-queries"), ["sensor_id", "dim", "value"])
    return hits.groupBy("query_id", "sensor_id", "pos").agg(F.count("*").alias("matches")).filter(F.col("matches") > threshold)


def expand(rows: DataFrame, queries: DataFrame, reach: int) -> DataFrame:
    """query_id, sensor_id, pos, count, acd: for each entry, in how many dimensions it lies within `reach` buckets of the
    query, and its distance so far (squared). The range is a set of values per query dimension, so this is an equi-join."""
    near = queries.select("query_id", "sensor_id", "dim", "kw", F.explode(F.sequence(F.col("kw") - reach, F.col("kw") + reach)).alias("value"))
    d = (F.col("value") - F.col("kw")).cast("double")
    return rows.join(_known(near, "near-buckets"), ["sensor_id", "dim", "value"]).groupBy("query_id", "sensor_id", "pos").agg(F.count("*").alias("count"), F.sum(d * d).alias("acd"))


def _buckets(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, sensor_id, dim, kw, value, side, before: every bucket of a query's dimensions, and how many entries lie
    between it and the query's own on its side. Sorted are buckets, of which a dimension has few, never entries."""
    from pyspark.sql import Window

    away = F.col("value") - F.col("kw")
    near = lists(rows).join(queries.select("query_id", "sensor_id", "dim", "kw"), ["sensor_id", "dim"]).withColumn("side", F.signum(away).cast("int"))
    closer = Window.partitionBy("query_id", "dim", "side").orderBy(F.abs(away)).rowsBetween(Window.unboundedPreceding, -1)
    return near.select("query_id", "sensor_id", "dim", "kw", "value", "side", F.coalesce(F.sum("n").over(closer), F.lit(0)).alias("before"))


def expansion(rows: DataFrame, queries: DataFrame, entries: int, bound: int | None = None) -> DataFrame:
    """query_id, sensor_id, dim, kw, value: the buckets that a bidirectional expansion visits: the query's own in every
    dimension, then downwards and upwards, on each side until `entries` postings are reached (the bucket that reaches them
    included), or buckets are further than `bound` away."""
    chosen = _buckets(rows, queries).filter((F.col("side") == 0) | (F.col("before") < entries))
    if bound is not None:
        chosen = chosen.filter(F.abs(F.col("value") - F.col("kw")) <= bound)
    return chosen.select("query_id", "sensor_id", "dim", "kw", "value")


def expand_chosen(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, sensor_id, pos, count, acd of the entries in the chosen buckets."""
    d = (F.col("value") - F.col("kw")).cast("double")
    return rows.join(_known(chosen, "chosen-buckets"), ["sensor_id", "dim", "value"]).groupBy("query_id", "sensor_id", "pos").agg(F.count("*").alias("count"), F.sum(d * d).alias("acd"))


def _sorted_ends(ends: DataFrame) -> DataFrame:
    return _known(ends.groupBy("query_id").agg(F.array_sort(F.collect_list("lb")).alias("lbs"), F.array_sort(F.collect_list("ub")).alias("ubs")), "bounds")


def frontier_bounds(rows: DataFrame, queries: DataFrame, entries: int) -> DataFrame:
    """query_id, lbs, ubs: per query the sorted least and most that a dimension outside the expansion adds to a distance: the
    squares of the nearest and the farthest bucket not visited. Where all buckets were visited no entry is outside, so the
    least is infinite and the most 0."""
    far = F.when((F.col("side") != 0) & (F.col("before") >= entries), F.pow((F.col("value") - F.col("kw")).cast("double"), F.lit(2.0)))
    ends = _buckets(rows, queries).groupBy("query_id", "dim").agg(F.coalesce(F.min(far), F.lit(float("inf"))).alias("lb"), F.coalesce(F.max(far), F.lit(0.0)).alias("ub"))
    return _sorted_ends(ends)


def dimension_bounds(rows: DataFrame, queries: DataFrame, reach: int) -> DataFrame:
    """query_id, lbs, ubs: per query the sorted least and most that a dimension outside the reach adds to a distance,
    (reach + 1)^2 and the squared distance to the farther end of the sensor's domain."""
    domain = rows.groupBy("sensor_id", "dim").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    far = F.greatest(F.col("kw") - F.col("low"), F.col("high") - F.col("kw")).cast("double")
    ends = queries.join(domain, ["sensor_id", "dim"]).select("query_id", F.lit(float((reach + 1) ** 2)).alias("lb"), (far * far).alias("ub"))
    return _sorted_ends(ends)


def result_bounds(expanded: DataFrame, bounds: DataFrame, dims: int, threshold: int = 0) -> DataFrame:
    """Adds lb and ub of the whole distance: what is known, plus the least or the most that the other dimensions add."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = expanded.filter(F.col("count") > threshold).join(bounds, "query_id")
    open_ = F.lit(dims) - F.col("count")
    lb = F.col("acd") + total(F.slice("lbs", F.lit(1), open_.cast("int")))
    ub = F.col("acd") + total(F.expr(f"slice(ubs, cast(size(ubs) - ({dims} - count) + 1 as int), cast({dims} - count as int))"))
    return rows.select("query_id", "sensor_id", "pos", "count", "acd", lb.alias("lb"), F.when(open_ == 0, F.col("acd")).otherwise(ub).alias("ub"))


def finished(bounded: DataFrame, expanded_bounds: DataFrame, k: int, dims: int) -> DataFrame:
    """query_id, finished: whether the k-th smallest ub doesn't exceed the least lb of all other entries, those that no
    list has reached included."""
    from .search import top_k

    best = _known(top_k(bounded, ["query_id"], k, by="ub", tie="pos"), "best")
    kth = best.groupBy("query_id").agg(F.max("ub").alias("kth"), F.count("*").alias("n"))
    rest = bounded.join(best.select("query_id", "pos"), ["query_id", "pos"], "left_anti").groupBy("query_id").agg(F.min("lb").alias("rest"))
    unseen = expanded_bounds.select("query_id", F.aggregate("lbs", F.lit(0.0), lambda s, x: s + x).alias("unseen"))
    out = kth.join(rest, "query_id", "left").join(unseen, "query_id")
    return out.select("query_id", ((F.col("n") >= k) & (F.col("kth") <= F.least(F.coalesce("rest", F.lit(float("inf"))), "unseen"))).alias("finished"))


def nearest(rows: DataFrame, windows: DataFrame, queries: DataFrame, k: int, dims: int, entries: int = 64, most: int = 16) -> DataFrame:
    """query_id, sensor_id, pos, dist, rank: the exact k nearest windows of bucket values. The expansion goes four times as far
    until every query is finished (after `most` rounds all windows are verified); then the entries whose lb doesn't exceed
    the k-th ub are verified on whole windows. Postings and queries are written once, since every round reads them."""
    from .search import top_k

    rows, queries = stored(rows, "postings"), stored(queries, "index-queries")
    item = queries.groupBy("query_id", "sensor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "kw"))), lambda x: x.kw).alias("item"))
    item = _known(item, "items")
    whole = windows.select("sensor_id", F.col("start").alias("pos"), "c")
    exact = columns.squared_euclid(F.transform("item", lambda x: x.cast("double")), F.transform("c", lambda x: x.cast("double")))
    for _ in range(most):
        b = frontier_bounds(rows, queries, entries)
        bounded = stored(result_bounds(expand_chosen(rows, expansion(rows, queries, entries)), b, dims), "bounded")
        if finished(bounded, b, k, dims).agg(F.bool_and("finished")).first()[0]:
            kth = top_k(bounded, ["query_id"], k, by="ub", tie="pos").groupBy("query_id").agg(F.max("ub").alias("kth"))
            chosen = bounded.join(_known(kth, "kth"), "query_id").filter(F.col("lb") <= F.col("kth")).select("query_id", "sensor_id", "pos")
            found = _known(chosen, "verified").join(whole, ["sensor_id", "pos"]).join(item, ["query_id", "sensor_id"])
            return top_k(found.select("query_id", "sensor_id", "pos", exact.alias("dist")), ["query_id"], k, tie="pos")
        entries *= 4
    found = whole.join(item, "sensor_id")
    return top_k(found.select("query_id", "sensor_id", "pos", exact.alias("dist")), ["query_id"], k, tie="pos")


def prune_statistics(expanded: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id, touched, entries, pruned: how many windows the lists touched, and the share that they didn't."""
    n = windows.groupBy("sensor_id").agg(F.count("*").alias("entries"))
    touched = expanded.groupBy("query_id", "sensor_id").agg(F.count("*").alias("touched")).join(n, "sensor_id")
    return touched.select("query_id", "touched", "entries", (1 - F.col("touched") / F.col("entries")).alias("pruned"))
