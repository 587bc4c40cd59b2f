"""Neighbour search: scans in column expressions, and the exact index search on chunks of series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns, kernels
from ..sources.storage import stored
from .series import frame, windows

METRICS: dict[str, Callable] = {
    "euclid": lambda q, c, r: columns.squared_euclid(q, c),
    "l1": lambda q, c, r: columns.manhattan(q, c),
    "dtw": lambda q, c, r: columns.dtw(q, c, r),
    "vanilla": lambda q, c, r: columns.dtw(q, c),
    "bound": lambda q, c, r: columns.lb_enhanced(q, c, r),
}


def distances(series: DataFrame, items: DataFrame, length: int, metric: str = "euclid", band: int = 4, reserve: int = 0) -> DataFrame:
    """query_id, sensor_id, len, start, dist: every subsequence of the item's sensor against the item (query_id,
    sensor_id, item). reserve keeps that many last places out of the search."""
    c = windows(series, length, ahead=reserve) if reserve else windows(series, length)
    return c.join(items.select("query_id", "sensor_id", "item"), "sensor_id").select("query_id", "sensor_id", F.lit(length).alias("len"), "start", METRICS[metric](F.col("item"), F.col("c"), band).alias("dist"))


def top_k(rows: DataFrame, keys: list[str], k, by: str = "dist", tie: str = "start", skip: int = 0) -> DataFrame:
    """Adds rank (from 1) and keeps the k smallest per key (k a number or a column), ties by `tie`; skip drops that many
    best ones first. Spark limits every group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(by, tie))
    ranked = rows.withColumn("rank", rank)
    if skip:
        return ranked.filter((F.col("rank") > skip) & (F.col("rank") <= k + skip)).withColumn("rank", F.col("rank") - skip)
    return ranked.filter(F.col("rank") <= k)


def scan_top_k(series: DataFrame, items: DataFrame, length: int, k: int, metric: str = "euclid", band: int = 4, skip: int = 0, reserve: int = 0) -> DataFrame:
    return top_k(distances(series, items, length, metric, band, reserve), ["query_id", "len"], k, skip=skip)


FOUND = "query_id string, sensor_id string, len int, start long, dist double, verified long"
FOUND_TYPES = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64())


def index_top_k(series: DataFrame, queries: DataFrame, lengths: list[int], k: int, band: int = 8, window: int = 16, reserve: int = 0, mode: str = "both", exclude: int | None = None, chunk: int = 1 << 12, two_pass: bool = True, profile: bool = False, causal: bool = False) -> DataFrame:
    """query_id, sensor_id, len, rank, start, dist: the k nearest subsequences of each query's suffixes under banded DTW.

    queries: (query_id, sensor_id, q, start) with start the query's place in its sensor. Series are cut into chunks of
    bounded size, overlapping by the longest suffix and the band; a chunk's bounds see the values around it. The first
    pass verifies the k smallest bounds of every chunk, whose k-th distance over all chunks is a threshold for the query;
    the second pass verifies only starts whose bound doesn't exceed it. reserve keeps last places out, exclude keeps out
    starts within so many places of the query's own. causal counts reserve from the end of each query and not of its
    sensor, so that nothing after a query is searched for it. Fewer places than k: all of them.
    """
    longest = max(lengths)
    ends = series.groupBy("sensor_id").agg((F.max("t") + 1).alias("n"))
    # chunks are written once: both passes read them, and numbering and packing whole series costs more than a search
    chunks = stored(frame(series, longest - 1 + band, band, chunk).join(ends, "sensor_id"), "chunks")
    packs = pack_queries(queries)

    def place(values, row, at, size):
        """Which starts of a chunk a query may use, by length."""
        own = row["first"] + np.arange(len(values))
        ok = own // chunk == row["chunk"]
        if exclude is not None:
            ok &= np.abs(own - at) >= exclude
        end = min(row["n"], at + size) if causal else row["n"]
        return {length: ok & (own + length <= end - reserve) for length in lengths}

    def run(threshold: bool):
        def f(batches):
            for batch in batches:
                out: list[tuple] = []
                for i in range(batch.num_rows):
                    values = batch.column("values")[i].values.to_numpy(zero_copy_only=False)
                    row = {c: batch.column(c)[i].as_py() for c in ("sensor_id", "first", "chunk", "n", "pack")}
                    context = kernels.envelope(values, band)
                    for job in row["pack"]:
                        q, allowed = np.array(job["q"]), place(values, row, job["at"], len(job["q"]))
                        if not any(mask.any() for mask in allowed.values()):
                            continue
                        if threshold:
                            for length, d in kernels.first_distances(values, q, lengths, k, band, window, allowed, mode, context).items():
                                out += [(job["query_id"], row["sensor_id"], length, j, float(x), len(d)) for j, x in enumerate(d)]
                        else:
                            limit = dict(job["limits"] or []) if "limits" in job else None
                            for length, (s, d, verified) in kernels.top_k(values, q, lengths, k, band, window, allowed, limit, mode, context).items():
                                out += [(job["query_id"], row["sensor_id"], length, int(row["first"] + x), float(y), verified) for x, y in zip(s, d)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), FOUND_TYPES)], names=["query_id", "sensor_id", "len", "start", "dist", "verified"])

        return f

    def jobs(packed):
        # the join deals by sensor; verification is dealt by chunk and pack, so that no sensor keeps one task busy
        every = chunks.join(packed, "sensor_id").select("sensor_id", "first", "chunk", "n", "values", "p", "pack")
        n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return every.repartition(n, "sensor_id", "chunk", "p").drop("p")

    if two_pass:
        seeds = jobs(packs).mapInArrow(run(True), FOUND)
        tau = top_k(seeds, ["query_id", "len"], k).groupBy("query_id", "len").agg(F.max("dist").alias("tau"), F.count("*").alias("c")).filter(F.col("c") >= k)
        limits = tau.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("len", "tau"))).alias("limits"))
        packs = pack_queries(queries, limits)
    found = jobs(packs).mapInArrow(run(False), FOUND)
    if profile:
        return found
    return top_k(found, ["query_id", "len"], k).select("query_id", "sensor_id", "len", "rank", "start", "dist")


def index_profile(series: DataFrame, queries: DataFrame, lengths: list[int], k: int, band: int, window: int, chunk: int = 1 << 14) -> DataFrame:
    """query_id, len, verified, places: how many places the search of each query had to verify. A chunk reports its own
    count with each row it finds; counts are added over chunks."""
    found = index_top_k(series, queries, lengths, k, band, window, chunk=chunk, two_pass=False, profile=True)
    per_chunk = found.groupBy("query_id", "sensor_id", "len", F.floor(F.col("start") / chunk).alias("chunk")).agg(F.max("verified").alias("verified"))
    ends = series.groupBy("sensor_id").agg((F.max("t") + 1).alias("n"))
    total = per_chunk.groupBy("query_id", "sensor_id", "len").agg(F.sum("verified").alias("verified"))
    return total.join(ends, "sensor_id").select("query_id", "len", "verified", (F.col("n") - F.col("len") + 1).alias("places"))


def pack_queries(queries: DataFrame, limits: DataFrame | None = None, size: int = 16) -> DataFrame:
    """sensor_id, p, pack: a sensor's queries in arrays of about `size`, so that a chunk of its series is sent once per pack
    and not once per query."""
    one = queries.select(F.col("query_id").cast("string").alias("query_id"), "sensor_id", "q", F.col("start").alias("at"))
    fields = ["query_id", "q", "at"]
    if limits is not None:
        one, fields = one.join(limits, "query_id", "left"), [*fields, "limits"]
    counts = queries.groupBy("sensor_id").agg(F.ceil(F.count("*") / size).alias("packs"))
    dealt = one.join(counts, "sensor_id").withColumn("p", F.pmod(F.xxhash64("query_id"), F.col("packs")))
    return dealt.groupBy("sensor_id", "p").agg(F.collect_list(F.struct(*fields)).alias("pack"))


def disjoint_windows(series: DataFrame, w: int) -> DataFrame:
    """sensor_id, m, c: the m-th window of w places; a last incomplete one is left out."""
    packed = series.groupBy("sensor_id", F.floor(F.col("t") / w).alias("m")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    return packed.filter(F.size("p") == w).select("sensor_id", "m", F.transform("p", lambda x: x.v).alias("c"))


def window_bounds(series_envelopes: DataFrame, query_windows: DataFrame, w: int) -> DataFrame:
    """query_id, sensor_id, p, m, d2q, q2d: bounds of every query window (query_id, sensor_id, p, u, kw, up, lo: one row
    per place u) against every disjoint data window m of its sensor."""
    data = series_envelopes.filter(F.col("t") >= 0).select("sensor_id", F.floor(F.col("t") / w).alias("m"), F.pmod("t", F.lit(w)).cast("int").alias("u"), "v", F.col("up").alias("dup"), F.col("lo").alias("dlo"))
    rows = data.join(query_windows, ["sensor_id", "u"])
    d2q, q2d = columns.lb_term(F.col("v"), F.col("kw"), F.col("lo"), F.col("up")), columns.lb_term(F.col("kw"), F.col("v"), F.col("dlo"), F.col("dup"))
    return rows.groupBy("query_id", "sensor_id", "p", "m").agg(F.sum(d2q).alias("d2q"), F.sum(q2d).alias("q2d"), F.count("*").alias("places")).filter(F.col("places") == w).drop("places")


def query_windows(queries: DataFrame, w: int, r: int) -> DataFrame:
    """One row per query window p and place u: kw, and the query's envelope as distances up and lo."""
    up, lo = columns.envelope(F.col("q"), r, True), columns.envelope(F.col("q"), r, False)
    places = queries.select("query_id", "sensor_id", F.size("q").alias("m"), F.posexplode(F.arrays_zip(F.col("q").alias("kw"), up.alias("u1"), lo.alias("l1"))).alias("i", "x"))
    flat = places.select("query_id", "sensor_id", "i", "m", F.col("x.kw").alias("kw"), (F.col("x.u1") - F.col("x.kw")).alias("up"), (F.col("x.kw") - F.col("x.l1")).alias("lo"))
    starts = F.sequence(F.greatest(F.col("i") - w + 1, F.lit(0)), F.least(F.col("i"), F.col("m") - w))
    return flat.select("*", F.explode(starts).alias("p")).select("query_id", "sensor_id", "p", (F.col("i") - F.col("p")).alias("u"), "kw", "up", "lo")


def group_bounds(bounds: DataFrame, ends: DataFrame, query_length: int, lengths: list[int], w: int, mode: str = "both") -> DataFrame:
    """query_id, sensor_id, len, start, lb: bounds of all suffixes, summed over their whole windows from the end.

    A suffix that starts at s meets data window m with its window p = s' + (m * w - s), s' being the suffix's place in the
    query; one running sum along each diagonal serves all lengths.
    """
    diagonal = bounds.select("query_id", "sensor_id", "p", "m", "d2q", "q2d", (F.col("m") * w - F.col("p")).alias("shift"))
    back = Window.partitionBy("query_id", "sensor_id", "shift").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = diagonal.withColumn("d", F.sum("d2q").over(back)).withColumn("e", F.sum("q2d").over(back)).withColumn("tiles", F.count("*").over(back))
    # ec: places of the query's tail after its last whole window on this diagonal
    ec = F.pmod(F.lit(query_length) + F.col("shift"), F.lit(w))
    each = summed.withColumn("ec", ec).select("*", F.explode(F.array(*(F.lit(x) for x in lengths))).alias("len"))
    whole = F.floor((F.col("len") - F.col("ec")) / w)
    last = F.lit(query_length) - F.col("ec") - whole * w
    hit = each.filter((F.col("p") == last) & (F.col("tiles") == whole))
    lb = {"d2q": F.col("d"), "q2d": F.col("e")}.get(mode, F.greatest("d", "e"))
    out = hit.select("query_id", "sensor_id", "len", (F.col("shift") + query_length - F.col("len")).alias("start"), lb.alias("lb"))
    return out.join(ends, "sensor_id").filter("start >= 0 and start + len <= n").drop("n")


def thresholds(bounds: DataFrame, verify: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """query_id, len, tau: the largest true distance of the k smallest bounds; verify adds dist to (query_id, len,
    start)."""
    return verify(top_k(bounds, ["query_id", "len"], k, by="lb")).groupBy("query_id", "len").agg(F.max("dist").alias("tau"))


def candidates(bounds: DataFrame, tau: DataFrame) -> DataFrame:
    """Bounds that don't exceed their query's threshold."""
    return bounds.join(tau, ["query_id", "len"]).filter(F.col("lb") <= F.col("tau"))


def merge_top_k(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """A running top-k with newly verified rows."""
    return top_k(old.select("query_id", "len", "start", "dist").unionByName(new.select("query_id", "len", "start", "dist")).distinct(), ["query_id", "len"], k)


def strided_sample(rows: DataFrame, keys: list[str], order: str, step: int, k: int) -> DataFrame:
    """Every step-th row of each group, k of them at most."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("rn", rn - 1).filter((F.col("rn") % step == 0) & (F.col("rn") / step < k))


def finished(rows: DataFrame, key: str, flag: str) -> DataFrame:
    return rows.groupBy(key).agg(F.bool_and(flag).alias("finished"))
