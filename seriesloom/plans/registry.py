"""The registered queries over the driver's tables and their SQL equivalents.

Sensors are the event types of `events`, numbered by time. Queries run over all sensors and all places; where SQL over
whole tables would take too long, there is none, and tests compare the operator with brute force on small series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import forecast, gather, invlist, search, series
from ..operators import queries as q
from ..sources import files
from ..sources.storage import fresh_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Length of items, neighbours, band, index window and horizon in the queries that SQL checks.
L, K, R, W, H = 16, 8, 4, 8, 3


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return series.index_series(events, "event_type", "ts", "value", "event_id")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def latest(s: DataFrame, length: int = L, back: int = 0) -> DataFrame:
    """query_id, sensor_id, start, q, item: each sensor's latest history."""
    return q.latest(s, length, back).select(F.col("sensor_id").alias("query_id"), "sensor_id", "start", "q", F.col("q").alias("item"))


S = "s AS (SELECT event_type AS sensor_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"
P = S + ", p AS (SELECT sensor_id, list(v ORDER BY t) AS a, count(*) AS n FROM s GROUP BY sensor_id)"


def win(length: int = L, ahead: int = 0) -> str:
    return f"w AS (SELECT sensor_id, i AS start, a[i + 1:i + {length}] AS c, a[i + {length + ahead}] AS y FROM (SELECT *, unnest(range(0, n - {length + ahead} + 1)) AS i FROM p))"


Q = f"q AS (SELECT sensor_id AS query_id, sensor_id, n - {L} AS at, a[n - {L} + 1:n] AS q FROM p)"
EU = f"list_sum(list_transform(range(1, {L + 1}), lambda i: (c[i] - q[i]) * (c[i] - q[i])))"
L1 = f"list_sum(list_transform(range(1, {L + 1}), lambda i: abs(c[i] - q[i])))"


def dtw_sql(band: int | None, n: int = L) -> str:
    value = "(c[j[1]::INT] - q[i[1]::INT]) * (c[j[1]::INT] - q[i[1]::INT]) + least(now[i[1]::INT], prev[i[1]::INT + 1], prev[i[1]::INT])"
    cell = value if band is None else f"CASE WHEN abs(i[1] - j[1]) <= {band} THEN {value} ELSE 'inf'::DOUBLE END"
    places = f"list_transform(range(1, {n + 1}), lambda k: [k::DOUBLE])"
    inner = f"list_reduce({places}, lambda now, i: list_append(now, {cell}), ['inf'::DOUBLE])"
    return f"list_extract(list_reduce({places}, lambda prev, j: {inner}, list_concat([0::DOUBLE], list_transform(range(0, {n}), lambda k: 'inf'::DOUBLE))), -1)"


def band_sql(n: int, r: int = R, c: str = "c", q: str = "q") -> str:
    """Banded DTW of c and q with 2r + 1 cells a row: cell d of row j stands for place j + d - r - 1 of q."""
    inf, width = "'inf'::DOUBLE", 2 * r + 1
    at = f"(j[1]::INT + d[1]::INT - {r + 1})"
    value = f"CASE WHEN {at} BETWEEN 1 AND {n} THEN pow({c}[j[1]::INT] - {q}[{at}], 2) + least(coalesce(prev[d[1]::INT + 1], {inf}), prev[d[1]::INT], now[d[1]::INT]) ELSE {inf} END"
    places = lambda k: f"list_transform(range(1, {k + 1}), lambda k: [k::DOUBLE])"
    row = f"list_reduce({places(width)}, lambda now, d: list_append(now, {value}), [{inf}])[2:]"
    first = f"list_transform(range(1, {width + 1}), lambda k: CASE WHEN k = {r + 1} THEN 0::DOUBLE ELSE {inf} END)"
    return f"list_extract(list_reduce({places(n)}, lambda prev, j: {row}, {first}), {r + 1})"


def nearest_sql(lengths, k: int, longest: int, reserve: int = 0, exclude: int | None = None, until: str = "n") -> str:
    """nn: the k nearest of each query of qs (query_id, sensor_id, place, q of `longest` values) for every length, by banded
    DTW over the starts of p; `until` is the end of what may be searched."""
    near = "" if exclude is None else f" AND abs(i - place) >= {exclude}"
    parts = [f"SELECT query_id, sensor_id, {n} AS len, i AS start, a, a[i + 1:i + {n}] AS c, q[{longest - n + 1}:{longest}] AS q FROM (SELECT *, unnest(range(0, ({until}) - {n + reserve} + 1)) AS i FROM qs JOIN p USING (sensor_id)) WHERE true{near}" for n in lengths]
    dist = "CASE len " + " ".join(f"WHEN {n} THEN {band_sql(n)}" for n in lengths) + " END"
    return f"cand AS ({' UNION ALL '.join(parts)}), dd AS (SELECT query_id, sensor_id, len, start, a, {dist} AS dist FROM cand), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, len ORDER BY dist, start) AS rank FROM dd) WHERE rank <= {k})"


NEAREST = "SELECT query_id, len::INTEGER AS len, start::BIGINT AS start, rank::BIGINT AS rank, round(dist, 6) AS dist FROM nn"


def mixed_sql(qs: str, lengths, ks, horizon: int, exclude: int | None, until: str) -> str:
    """mx: mean and var of the unweighted expert grid over the queries of qs."""
    label = f"a[start + len + {horizon} + 1]"
    return (
        f"WITH {P}, {qs}, {nearest_sql(lengths, max(ks), max(lengths), horizon + 1, exclude, until)}, "
        f"gr AS (SELECT query_id, len, k, avg({label}) AS mean, greatest(avg(pow({label}, 2)) - pow(avg({label}), 2), 0) + 1e-4 AS var FROM nn, (SELECT unnest({list(ks)}) AS k) z WHERE rank <= k GROUP BY ALL), "
        "mx AS (SELECT query_id, avg(mean) AS mean, avg(var) AS var FROM gr GROUP BY query_id)"
    )


def experiment_sql(*grid) -> str:
    """Errors of the grid over queries that also hold the truth y."""
    return f"{mixed_sql(*grid)} SELECT query_id, round(mean, 8) AS mean, round(var, 4) AS var, round(y, 6) AS y, round(abs(y - mean), 8) AS ae, round(pow(y - mean, 2), 4) AS se, round(pow(y - mean, 2) / var, 4) AS sse, round((pow(y - mean, 2) / var + ln(var) + ln(2 * pi())) / 2, 4) AS nll FROM mx JOIN qs USING (query_id)"


def judged(rows: DataFrame) -> DataFrame:
    places = {"mean": 8, "var": 4, "y": 6, "ae": 8, "se": 4, "sse": 4, "nll": 4}
    return rows.select("query_id", *(F.round(c, n).alias(c) for c, n in places.items()))


def env_sql(a: str, r: int, f: str, n: int = L) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: list_{f}({a}[greatest(i - {r}, 1):least(i + {r}, {n})]))"


def keogh_sql(a: str, b: str, r: int = R, n: int = L) -> str:
    """b against the envelope of a."""
    up, lo = f"list_max({a}[greatest(i - {r}, 1):least(i + {r}, {n})])", f"list_min({a}[greatest(i - {r}, 1):least(i + {r}, {n})])"
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: CASE WHEN {b}[i] > {up} THEN pow({b}[i] - {up}, 2) WHEN {b}[i] < {lo} THEN pow({b}[i] - {lo}, 2) ELSE 0 END))"


def top_sql(dist: str, k: int = K, extra: str = "", skip: int = 0, ahead: int = 0) -> str:
    return f"WITH {P}, {win(ahead=ahead)}, {Q}, d AS (SELECT query_id, start, {dist} AS dist FROM w JOIN q USING (sensor_id) {extra}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, start) - {skip} AS rank FROM d) SELECT query_id, start::BIGINT AS start, rank::BIGINT AS rank, round(dist, 6) AS dist FROM r WHERE rank BETWEEN 1 AND {k}"


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "start", F.col("rank").cast("long").alias("rank"), r6("dist", "dist"))


# --- sources and sinks


def _csv(spark, sf_dir, cols=("sensor_id", "t", "v")):
    path = fresh_path(spark, "series-csv")
    files.write_series_csv(sensors(spark, sf_dir), path, list(cols))
    return path


@register("op_s01_read_csv_column", f"WITH {S} SELECT round(v, 6) AS value FROM s")
def _(spark, sf):
    return files.read_csv_column(spark, _csv(spark, sf), 2).select(r6("value", "value"))


@register("op_s02_read_typed", f"WITH {S} SELECT t::INTEGER AS value FROM s")
def _(spark, sf):
    return files.read_csv_column(spark, _csv(spark, sf), 1, "int").select("value")


@register("op_s03_read_matrix", f"WITH {S} SELECT t::DOUBLE AS t, round(v, 6) AS v FROM s")
def _(spark, sf):
    m = files.read_matrix(spark, _csv(spark, sf, ("t", "v")))
    return m.select(F.get("row", F.lit(0)).alias("t"), r6(F.get("row", F.lit(1)), "v"))


@register("op_s04_read_matrix_comma", f"WITH {S} SELECT t::DOUBLE AS t, round(v, 6) AS v FROM s")
def _(spark, sf):
    m = files.read_matrix(spark, _csv(spark, sf, ("t", "v")), ",")
    return m.select(F.get("row", F.lit(0)).alias("t"), r6(F.get("row", F.lit(1)), "v"))


@register("op_s05_columns_as_series", f"WITH {S} SELECT 0 AS sensor, t::DOUBLE AS value FROM s UNION ALL SELECT 1, round(v, 6) FROM s")
def _(spark, sf):
    return files.read_columns_as_series(spark, _csv(spark, sf, ("t", "v")), 0, 1).select("sensor", r6("value", "value"))


@register("op_s06_load_series", f"WITH {S} SELECT sensor_id, t::BIGINT AS t, v FROM s")
def _(spark, sf):
    return sensors(spark, sf)


def _stored_queries(spark, sf, kind="double", write=files.write_queries):
    path = fresh_path(spark, "queries")
    write(latest(sensors(spark, sf)), path)
    return files.read_queries(spark, path, kind)


@register("op_s07_read_queries", f"WITH {P}, {Q} SELECT round(list_sum(q), 6) AS total, len(q)::INTEGER AS n FROM q")
def _(spark, sf):
    return _stored_queries(spark, sf).select(r6(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), "total"), F.size("q").alias("n"))


@register("op_s08_write_queries", f"WITH {P}, {Q} SELECT list_sum(list_transform(q, lambda x: trunc(x)::BIGINT))::BIGINT AS total FROM q")
def _(spark, sf):
    ints = _stored_queries(spark, sf, "long", lambda d, p: files.write_queries(d, p, "long"))
    return ints.select(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("op_s09_write_composite_queries", f"WITH {P}, {Q} SELECT list_sum(list_transform(range(1, {L + 1}), lambda i: ((i - 1) << 12) + trunc(q[i])::BIGINT))::BIGINT AS total FROM q")
def _(spark, sf):
    def write(d, p):
        files.write_composite_queries(d.withColumn("q", F.transform("q", lambda x: x.cast("long"))), p, 12)

    return _stored_queries(spark, sf, "long", write).select(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("op_s10_binary_queries", f"WITH {P}, {Q} SELECT query_id, round(list_sum(q), 6) AS total FROM q")
def _(spark, sf):
    path = fresh_path(spark, "queries-parquet")
    latest(sensors(spark, sf)).select("query_id", "q").write.parquet(path)
    return spark.read.parquet(path).select("query_id", r6(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), "total"))


BUCKETED = f"{P}, {win()}, b AS (SELECT sensor_id, start, list_transform(c, lambda x: trunc(x / 10)::BIGINT) AS c FROM w), x AS (SELECT sensor_id, start AS pos, unnest(range(0, {L})) AS dim, unnest(c) AS value FROM b)"


def _bucketed(spark, sf) -> DataFrame:
    return series.bucketise(sensors(spark, sf), width=10.0).select("sensor_id", "t", F.col("bucket").cast("double").alias("v"))


def _bucket_windows(spark, sf) -> DataFrame:
    return series.windows(_bucketed(spark, sf), L).withColumn("c", F.transform("c", lambda x: x.cast("long")))


@register("op_s11_write_postings", f"WITH {BUCKETED} SELECT dim::INTEGER AS dim, value::BIGINT AS value, count(*) AS n, sum(pos)::BIGINT AS places FROM x GROUP BY ALL")
def _(spark, sf):
    path = fresh_path(spark, "postings")
    files.write_postings(invlist.postings(_bucket_windows(spark, sf)), path)
    return files.read_postings(spark, path).groupBy("dim", "value").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@register("op_s12_read_postings", f"WITH {BUCKETED}, l AS (SELECT sensor_id, dim, value, count(*) AS n FROM x GROUP BY ALL) SELECT sensor_id, dim::INTEGER AS dim, value::BIGINT AS value, sum(n) OVER (PARTITION BY sensor_id ORDER BY dim, value)::BIGINT AS end_offset FROM l")
def _(spark, sf):
    from pyspark.sql import Window

    path = fresh_path(spark, "postings")
    files.write_postings(invlist.postings(_bucket_windows(spark, sf)), path)
    ends = F.sum("n").over(Window.partitionBy("sensor_id").orderBy("dim", "value"))
    return invlist.lists(files.read_postings(spark, path)).select("sensor_id", "dim", "value", ends.alias("end_offset"))


@register("op_s13_random_postings", "SELECT dim::INTEGER AS dim, 1000::BIGINT AS n, true AS inside FROM range(0, 32) t(dim)")
def _(spark, sf):
    """How many random postings each dimension has, and whether all values and places are in their ranges."""
    inside = F.bool_and(F.col("value").between(0, 127) & F.col("pos").between(0, 999))
    return files.random_postings(spark, 32, 128, 1000).groupBy("dim").agg(F.count("*").alias("n"), inside.alias("inside"))


@register("op_s14_write_training_csv", f"WITH {P}, {win(L, 1)} SELECT round(list_sum(c), 4) AS x_total, round(y, 6) AS y FROM w")
def _(spark, sf):
    path = fresh_path(spark, "training")
    rows = q.training_set(sensors(spark, sf), L, 1).select(F.concat_ws(",", F.transform("x", lambda x: x.cast("string")), F.col("y").cast("string")).alias("value"))
    rows.write.text(path)
    m = files.read_matrix(spark, path, ",")
    return m.select(F.round(F.aggregate(F.slice("row", 1, L), F.lit(0.0), lambda a, x: a + x), 4).alias("x_total"), r6(F.element_at("row", -1), "y"))


@register("op_s15_matrix_decimals", f"WITH {S} SELECT t::DOUBLE AS t, round(v, 3) AS v FROM s")
def _(spark, sf):
    path = fresh_path(spark, "matrix")
    rows = sensors(spark, sf).select(F.monotonically_increasing_id().alias("line"), F.array(F.col("t").cast("double"), "v").alias("row"))
    files.write_matrix(rows, path, 3)
    return files.read_matrix(spark, path, ",").select(F.get("row", F.lit(0)).alias("t"), F.round(F.get("row", F.lit(1)), 3).alias("v"))


# --- pre-processing


@register("op_p01_znormalise", f"WITH {S} SELECT sensor_id, t::BIGINT AS t, round((v - avg(v) OVER w) / stddev_pop(v) OVER w * 100, 6) AS z FROM s WINDOW w AS (PARTITION BY sensor_id)")
def _(spark, sf):
    return series.znormalise(sensors(spark, sf), 100.0).select("sensor_id", "t", r6("z", "z"))


@register("op_p02_znormalise_columns", f"WITH {S}, b AS (SELECT * FROM s UNION ALL SELECT sensor_id || '#t', t, t FROM s) SELECT sensor_id, t::BIGINT AS t, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS z FROM b WINDOW w AS (PARTITION BY sensor_id)")
def _(spark, sf):
    s = sensors(spark, sf)
    both = s.unionByName(s.select(F.concat("sensor_id", F.lit("#t")).alias("sensor_id"), "t", F.col("t").cast("double").alias("v")))
    return series.znormalise(both).select("sensor_id", "t", r6("z", "z"))


@register("op_p03_mean_deviation", f"WITH {S} SELECT sensor_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM s GROUP BY sensor_id")
def _(spark, sf):
    return series.mean_deviation(sensors(spark, sf)).select("sensor_id", r6("mean", "mean"), r6("deviation", "deviation"))


@register("op_p04_training_set", f"WITH {P}, {win(L, H)} SELECT sensor_id, start::BIGINT AS start, round(list_sum(c), 6) AS x_total, round(y, 6) AS y FROM w")
def _(spark, sf):
    return q.training_set(sensors(spark, sf), L, H).select("sensor_id", "start", r6(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), "x_total"), r6("y", "y"))


@register("op_p05_drop_missing", f"WITH {S}, m AS (SELECT sensor_id, t, CASE WHEN v < 5 THEN -1 ELSE v END AS v FROM s) SELECT sensor_id, t::BIGINT AS t, v FROM m WHERE v <> -1")
def _(spark, sf):
    marked = sensors(spark, sf).withColumn("v", F.when(F.col("v") < 5, -1.0).otherwise(F.col("v")))
    return series.drop_missing(marked)


@register("op_p06_bucketise", f"WITH {S}, w AS (SELECT sensor_id, (max(v) - min(v)) / 31 AS width FROM s GROUP BY sensor_id) SELECT sensor_id, t::BIGINT AS t, trunc(v / width)::INTEGER AS bucket FROM s JOIN w USING (sensor_id)")
def _(spark, sf):
    return series.bucketise(sensors(spark, sf), n=32).select("sensor_id", "t", "bucket")


@register("op_p07_read_bucketise", f"WITH {S} SELECT trunc(v / 2.5)::INTEGER AS bucket FROM s")
def _(spark, sf):
    read = files.read_csv_column(spark, _csv(spark, sf), 2).withColumnRenamed("value", "v")
    return series.bucketise(read, width=2.5).select("bucket")


@register("op_p08_keywords", f"WITH {S} SELECT sensor_id, t::BIGINT AS t, trunc(v + 0.5)::INTEGER AS k1, trunc(v / 2.5)::INTEGER AS k2, trunc(v / 2.5) * 2.5 AS low, (trunc(v / 2.5) + 1) * 2.5 AS high FROM s")
def _(spark, sf):
    k2 = series.keyword(F.col("v"), 2.5)
    low, high = series.keyword_edges(k2, 2.5)
    return sensors(spark, sf).select("sensor_id", "t", series.keyword(F.col("v"), 1).alias("k1"), k2.alias("k2"), low.cast("double").alias("low"), high.cast("double").alias("high"))


@register("op_p09_standardise", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS price FROM lineitem")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = {"l_quantity": "quantity", "l_extendedprice": "price"}
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    return rows.crossJoin(F.broadcast(stats)).select("l_orderkey", "l_linenumber", *(r6((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), n) for c, n in cols.items()))


@register("op_p10_widen", "SELECT o_orderkey, o_custkey::DOUBLE AS value FROM orders")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("double").alias("value"))


# --- query construction

STARTS = "st AS (SELECT sensor_id, n, a, i, i * ((n - 2 * 16 - 1) // 20) + 16 AS start FROM p, range(0, 20) t(i))"


def _q(df: DataFrame) -> DataFrame:
    return df.select("sensor_id", "start", r6(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), "total"))


@register("op_q01_sample", f"WITH {P}, {STARTS} SELECT sensor_id, start::BIGINT AS start, round(list_sum(a[start + 1:start + 16]), 6) AS total FROM st")
def _(spark, sf):
    return _q(q.sample_queries(sensors(spark, sf), L, 20))


@register("op_q02_sample_plain", f"WITH {P}, st AS (SELECT sensor_id, a, i * ((n - 16) // 20) AS start FROM p, range(0, 20) t(i)) SELECT sensor_id, start::BIGINT AS start, round(list_sum(a[start + 1:start + 16]), 6) AS total FROM st")
def _(spark, sf):
    return _q(q.sample_queries(sensors(spark, sf), L, 20, "plain"))


@register("op_q03_sequential", f"WITH {P} SELECT sensor_id, start::BIGINT AS start, round(list_sum(a[start + 1:start + 16]), 6) AS total FROM p, range(50, 60) t(start)")
def _(spark, sf):
    return _q(q.sequential_queries(sensors(spark, sf), 50, 10, L))


@register("op_q04_persist", f"WITH {P}, {STARTS} SELECT round(list_sum(a[start + 1:start + 16]), 6) AS total FROM st")
def _(spark, sf):
    path = fresh_path(spark, "sampled")
    files.write_queries(q.sample_queries(sensors(spark, sf), L, 20), path)
    return files.read_queries(spark, path).select(r6(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), "total"))


@register("op_q05_series_with_queries", f"WITH {P}, {STARTS} SELECT sensor_id, start::BIGINT AS start, n::BIGINT AS n FROM st")
def _(spark, sf):
    s = sensors(spark, sf)
    return q.sample_queries(s, L, 20).join(series.lengths(s), "sensor_id").select("sensor_id", "start", "n")


@register("op_q06_leave_out", f"WITH {P}, {STARTS}, k AS (SELECT sensor_id || '@' || start AS query_id, sensor_id, start FROM st), x AS (SELECT query_id, t, v FROM k JOIN s USING (sensor_id) WHERE t < greatest(start - 16, 0) OR t >= start + 16) SELECT query_id, count(*) AS n, max(rn)::BIGINT AS last, round(sum(v), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t) - 1 AS rn FROM x) GROUP BY query_id")
def _(spark, sf):
    s = sensors(spark, sf)
    cuts = q.sample_starts(s, L, 20).select(F.concat_ws("@", "sensor_id", "start").alias("query_id"), "sensor_id", "start")
    return series.leave_out(s, cuts, L).groupBy("query_id").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.round(F.sum("v"), 4).alias("total"))


@register("op_q07_align_step", f"WITH {P}, e AS (SELECT sensor_id, a[n - 39:n] AS q FROM p), g AS (SELECT sensor_id, q, unnest(range(0, 10)) AS step FROM e) SELECT sensor_id, step::INTEGER AS step, round(list_sum(q[step + 1:step + 16]), 6) AS x_total, q[step + 16 + {H} + 1] AS y FROM g")
def _(spark, sf):
    base = q.latest(sensors(spark, sf), 40)
    out = None
    for step in range(10):
        one = q.align_step(base, step, L, H).select("sensor_id", F.lit(step).alias("step"), r6(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), "x_total"), "y")
        out = one if out is None else out.unionByName(one)
    return out


@register("op_q08_align_query", f"WITH {P}, e AS (SELECT sensor_id, a[n - 39:n] AS q FROM p) SELECT sensor_id, round(list_sum(q[6:21]), 6) AS total FROM e")
def _(spark, sf):
    return q.latest(sensors(spark, sf), 40).select("sensor_id", r6(F.aggregate(F.slice("q", 6, L), F.lit(0.0), lambda a, x: a + x), "total"))


@register("op_q09_items", f"WITH {P}, e AS (SELECT sensor_id, a[n - 31:n] AS q, unnest([8, 16, 32]) AS len FROM p) SELECT sensor_id, len::INTEGER AS len, round(list_sum(q[32 - len + 1:32]), 6) AS total FROM e")
def _(spark, sf):
    i = q.items(q.latest(sensors(spark, sf), 32), [8, 16, 32])
    return i.select("sensor_id", "len", r6(F.aggregate("item", F.lit(0.0), lambda a, x: a + x), "total"))


@register("op_q10_group_items", f"WITH r AS ({top_sql(EU)}) SELECT query_id, list(start ORDER BY rank) AS starts FROM r GROUP BY query_id")
def _(spark, sf):
    s = sensors(spark, sf)
    found = search.scan_top_k(s, latest(s), L, K)
    return q.group_items(found, ["query_id"]).select("query_id", F.transform("results", lambda x: x.start).alias("starts"))


@register("op_q12_replicate", f"WITH {S} SELECT sensor_id || '#' || i AS sensor_id, count(*) AS n, round(sum(v), 4) AS total FROM s, range(0, 4) t(i) GROUP BY 1")
def _(spark, sf):
    return series.replicate(sensors(spark, sf), 4).groupBy("sensor_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@register("op_q13_trim_tail", f"WITH {S} SELECT sensor_id, count(*) AS n, max(t)::BIGINT AS last FROM s WHERE t < (SELECT max(t) + 1 FROM s x WHERE x.sensor_id = s.sensor_id) - 21 GROUP BY sensor_id")
def _(spark, sf):
    return series.trim_tail(sensors(spark, sf), 21).groupBy("sensor_id").agg(F.count("*").alias("n"), F.max("t").alias("last"))


# --- distances and bounds


def _pairs(spark, sf) -> DataFrame:
    s = sensors(spark, sf)
    return series.windows(s, L).join(latest(s).select("sensor_id", F.col("item").alias("q")), "sensor_id")


def _pair_sql(expr: str) -> str:
    return f"WITH {P}, {win()}, {Q} SELECT sensor_id, start::BIGINT AS start, round({expr}, 6) AS dist FROM w JOIN q USING (sensor_id)"


for _name, _expr, _sql in (
    ("op_d01_squared_euclid", columns.squared_euclid, EU),
    ("op_d02_manhattan", columns.manhattan, L1),
    ("op_d03_dtw", lambda a, c: columns.dtw(a, c), dtw_sql(None)),
    ("op_d04_dtw_band", lambda a, c: columns.dtw(a, c, R), dtw_sql(R)),
    ("op_d05_dtw_half_band", lambda a, c: columns.dtw(a, c, L // 2), dtw_sql(L // 2)),
    ("op_d08_lb_keogh_query", lambda a, c: columns.lb_keogh(a, c, R), keogh_sql("q", "c")),
    ("op_d09_lb_keogh_data", lambda a, c: columns.lb_keogh(c, a, R), keogh_sql("c", "q")),
    ("op_d10_lb_enhanced", lambda a, c: columns.lb_enhanced(a, c, R), f"greatest({keogh_sql('q', 'c')}, {keogh_sql('c', 'q')})"),
):

    @register(_name, _pair_sql(_sql))
    def _(spark, sf, e=_expr):
        return _pairs(spark, sf).select("sensor_id", "start", r6(e(F.col("q"), F.col("c")), "dist"))


ENV = f"{S}, e AS (SELECT sensor_id, t, v, max(v) OVER f - v AS up, v - min(v) OVER f AS lo FROM s WINDOW f AS (PARTITION BY sensor_id ORDER BY t ROWS BETWEEN {R} PRECEDING AND {R} FOLLOWING))"


def _term_sql(p: int) -> str:
    over = "(abs(v - kw) - CASE WHEN v <= kw THEN lo ELSE up END)"
    return f"CASE WHEN {over} <= 0 THEN 0 ELSE pow({over}, {p}) END"


@register("op_d11_lb_terms", f"WITH {ENV}, x AS (SELECT *, lag(v, 1, v) OVER (PARTITION BY sensor_id ORDER BY t) AS kw FROM e) SELECT sensor_id, t::BIGINT AS t, round({_term_sql(2)}, 6) AS l2, round({_term_sql(1)}, 6) AS l1, round({_term_sql(0)}, 6) AS l0 FROM x")
def _(spark, sf):
    e = series.envelopes(sensors(spark, sf), R)
    before = e.select("sensor_id", (F.col("t") + 1).alias("t"), F.col("v").alias("kw"))
    x = e.join(before, ["sensor_id", "t"], "left").withColumn("kw", F.coalesce("kw", "v"))
    return x.select("sensor_id", "t", *(r6(columns.lb_term(F.col("v"), F.col("kw"), F.col("lo"), F.col("up"), p), f"l{p}") for p in (2, 1, 0)))


def _lp_sql(p: int) -> str:
    return f"CASE WHEN abs(v - 50) <= 5 OR v = 50 THEN 0 ELSE pow(abs(v - 50) - 5, {p}) END * 0.5"


@register("op_d12_weighted_lp", f"WITH {S} SELECT sensor_id, t::BIGINT AS t, round({_lp_sql(0)}, 6) AS p0, round({_lp_sql(1)}, 6) AS p1, round({_lp_sql(2)}, 6) AS p2, round({_lp_sql(3)}, 4) AS p3 FROM s")
def _(spark, sf):
    e = [columns.weighted_lp(F.col("v"), F.lit(50.0), F.lit(0.5), F.lit(5.0), p) for p in range(4)]
    return sensors(spark, sf).select("sensor_id", "t", *(r6(x, f"p{i}") for i, x in enumerate(e[:3])), F.round(e[3], 4).alias("p3"))


@register("op_d13_query_envelope", f"WITH {P}, {Q} SELECT sensor_id, i::INTEGER AS i, round({env_sql('q', R, 'max')}[i + 1] - q[i + 1], 6) AS up, round(q[i + 1] - {env_sql('q', R, 'min')}[i + 1], 6) AS lo FROM (SELECT *, unnest(range(0, {L})) AS i FROM q)".replace("lambda i:", "lambda z:").replace("i - 4, 1", "z - 4, 1").replace("least(i + 4", "least(z + 4"))
def _(spark, sf):
    w = search.query_windows(latest(sensors(spark, sf)), 1, R)
    return w.select("sensor_id", F.col("p").alias("i"), r6("up", "up"), r6("lo", "lo"))


@register("op_d14_data_envelope", f"WITH {ENV} SELECT sensor_id, t::BIGINT AS t, round(up, 6) AS up, round(lo, 6) AS lo FROM e")
def _(spark, sf):
    return series.envelopes(sensors(spark, sf), R).select("sensor_id", "t", r6("up", "up"), r6("lo", "lo"))


# --- scans


@register("op_k01_scan", top_sql(EU))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.scan_top_k(s, latest(s), L, K))


@register("op_k02_scan_dtw", top_sql(dtw_sql(R)))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.scan_top_k(s, latest(s), L, K, "dtw", R))


@register("op_k03_scan_cascade", top_sql(dtw_sql(R)))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.index_top_k(s, latest(s), [L], K, R, W, two_pass=False))


@register("op_k04_scan_early_stop", top_sql(dtw_sql(R), 3))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.index_top_k(s, latest(s), [L], 3, R, W))


@register("op_k05_distance_matrix", f"WITH {P}, {win(ahead=H)}, {Q} SELECT sensor_id, start::BIGINT AS start, round({EU}, 6) AS dist FROM w JOIN q USING (sensor_id)")
def _(spark, sf):
    s = sensors(spark, sf)
    return search.distances(s, latest(s), L, reserve=H).select("sensor_id", "start", r6("dist", "dist"))


@register("op_k06_scan_reserve", top_sql(EU, ahead=H))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.scan_top_k(s, latest(s), L, K, reserve=H))


@register("op_k07_scan_bound", top_sql(f"greatest({keogh_sql('q', 'c')}, {keogh_sql('c', 'q')})"))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.scan_top_k(s, latest(s), L, K, "bound", R))


@register("op_k08_scan_ignore_first", top_sql(EU, skip=1))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.scan_top_k(s, latest(s), L, K, skip=1))


@register("op_k09_group_scan", f"WITH {P}, {win(L, H + 1)}, {Q}, d AS (SELECT query_id, start, y, {EU} AS dist FROM w JOIN q USING (sensor_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, start) AS rank FROM d) SELECT query_id, start::BIGINT AS start, rank::BIGINT AS rank, y FROM r WHERE rank <= {K}")
def _(spark, sf):
    s = sensors(spark, sf)
    found = search.scan_top_k(s, latest(s), L, K, reserve=H + 1)
    return gather.training_rows(s, found, H).select("query_id", "start", F.col("rank").cast("long").alias("rank"), "y")


@register("op_k10_vector_scan", "WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS start, list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), start) AS rank FROM d) SELECT query_id, rank::BIGINT AS rank, round(dist, 6) AS dist FROM r WHERE rank <= 4")
def _(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    pairs = v.join(v.select(F.col("vec_id").alias("start"), "label", F.col("e").alias("c")), "label")
    d = pairs.select(F.col("vec_id").alias("query_id"), "start", columns.squared_euclid("e", "c").alias("dist"))
    return search.top_k(d.withColumn("near", F.round("dist", 9)), ["query_id"], 4, by="near").select("query_id", F.col("rank").cast("long").alias("rank"), r6("dist", "dist"))


@register("op_k11_min_k", f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY v, t) AS rank FROM s) SELECT sensor_id, t::BIGINT AS t, rank::BIGINT AS rank FROM r WHERE rank <= 5")
def _(spark, sf):
    return search.top_k(sensors(spark, sf), ["sensor_id"], 5, by="v", tie="t").select("sensor_id", "t", F.col("rank").cast("long").alias("rank"))


# --- index search


def _windows_sql(mode: str) -> str:
    """Window bounds as the index computes them: query windows p against disjoint data windows m."""
    qe = f"qe AS (SELECT sensor_id, i, q[i + 1] AS kw, list_max(q[greatest(i + 1 - {R}, 1):least(i + 1 + {R}, 32)]) - q[i + 1] AS up, q[i + 1] - list_min(q[greatest(i + 1 - {R}, 1):least(i + 1 + {R}, 32)]) AS lo FROM (SELECT sensor_id, a[n - 31:n] AS q, unnest(range(0, 32)) AS i FROM p))"
    qw = f"qw AS (SELECT sensor_id, p, i - p AS u, kw, up, lo FROM qe, range(0, 32 - {W} + 1) t(p) WHERE i >= p AND i < p + {W})"
    term = lambda v, k, lo, up: f"CASE WHEN abs({v} - {k}) - CASE WHEN {v} <= {k} THEN {lo} ELSE {up} END <= 0 THEN 0 ELSE pow(abs({v} - {k}) - CASE WHEN {v} <= {k} THEN {lo} ELSE {up} END, 2) END"
    wb = f"wb AS (SELECT sensor_id, p, t // {W} AS m, sum({term('v', 'kw', 'qw.lo', 'qw.up')}) AS d2q, sum({term('kw', 'v', 'e.lo', 'e.up')}) AS q2d FROM e JOIN qw USING (sensor_id) WHERE t % {W} = u GROUP BY ALL HAVING count(*) = {W})"
    env = ENV.removeprefix(S + ", ")
    return f"{P}, {env}, {qe}, {qw}, {wb}"


def _bounds(spark, sf):
    s = sensors(spark, sf)
    qs = latest(s, 32).select("query_id", "sensor_id", "q")
    return s, search.window_bounds(series.envelopes(s, R), search.query_windows(qs, W, R), W)


@register("op_w03_query_windows", f"WITH {P}, e AS (SELECT sensor_id, a[n - 31:n] AS q FROM p), w AS (SELECT sensor_id, q, unnest(range(0, 32 - {W} + 1)) AS p FROM e) SELECT sensor_id, p::INTEGER AS p, round(list_sum(q[p + 1:p + {W}]), 6) AS total FROM w")
def _(spark, sf):
    w = search.query_windows(latest(sensors(spark, sf), 32), W, R)
    return w.groupBy("sensor_id", "p").agg(r6(F.sum("kw"), "total"))


@register("op_w04_window_bounds", f"WITH {_windows_sql('d2q')} SELECT sensor_id, p::INTEGER AS p, m::BIGINT AS m, round(d2q, 5) AS d2q FROM wb")
def _(spark, sf):
    return _bounds(spark, sf)[1].select("sensor_id", "p", "m", F.round("d2q", 5).alias("d2q"))


@register("op_w05_window_bounds_both", f"WITH {_windows_sql('both')} SELECT sensor_id, p::INTEGER AS p, m::BIGINT AS m, round(d2q, 5) AS d2q, round(q2d, 5) AS q2d FROM wb")
def _(spark, sf):
    return _bounds(spark, sf)[1].select("sensor_id", "p", "m", F.round("d2q", 5).alias("d2q"), F.round("q2d", 5).alias("q2d"))


GROUP = f"x AS (SELECT sensor_id, len, unnest(range(0, n - len + 1)) AS start FROM p, (SELECT unnest([16, 32]) AS len) l), y AS (SELECT *, (start + len) % {W} AS ec, (len - (start + len) % {W}) // {W} AS tiles FROM x), g AS (SELECT y.sensor_id, y.len, y.start, sum(d2q) AS d, sum(q2d) AS e, count(*) AS c, max(tiles) AS tiles FROM y JOIN wb ON wb.sensor_id = y.sensor_id AND wb.m * {W} - wb.p = y.start + y.len - 32 AND wb.p >= 32 - y.ec - y.tiles * {W} AND (wb.p - (32 - y.ec)) % {W} = 0 AND wb.p + {W} <= 32 - y.ec GROUP BY ALL)"


@register("op_w06_group_bounds", f"WITH {_windows_sql('both')}, {GROUP} SELECT sensor_id, len::INTEGER AS len, start::BIGINT AS start, round(greatest(d, e), 5) AS lb FROM g WHERE c = tiles")
def _(spark, sf):
    s, b = _bounds(spark, sf)
    return search.group_bounds(b, series.lengths(s), 32, [16, 32], W).select("sensor_id", "len", "start", F.round("lb", 5).alias("lb"))


def _verified(s: DataFrame):
    """Adds the true distances of (query_id, len, start) rows of one length L."""
    items = latest(s)

    def verify(rows):
        w = series.windows(s, L)
        return rows.join(items.select("query_id", "item"), "query_id").join(w, ["sensor_id", "start"]).withColumn("dist", columns.dtw(F.col("item"), F.col("c"), R)).drop("item", "c")

    return verify


def _threshold_parts(spark, sf):
    s, b = _bounds(spark, sf)
    bounds = search.group_bounds(b, series.lengths(s), 32, [L], W)
    return s, bounds, search.thresholds(bounds, _verified(s), K)


_TAU = f"{_windows_sql('both')}, {GROUP}, lb AS (SELECT sensor_id, start, greatest(d, e) AS lb FROM g WHERE c = tiles AND len = {L}), first AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY lb, start) AS rank FROM lb), {win()}, {Q}, tau AS (SELECT sensor_id, max({dtw_sql(R)}) AS tau FROM first JOIN w USING (sensor_id, start) JOIN q USING (sensor_id) WHERE rank <= {K} GROUP BY sensor_id)"


@register("op_w08_threshold", f"WITH {_TAU} SELECT sensor_id AS query_id, round(tau, 4) AS tau FROM tau")
def _(spark, sf):
    return _threshold_parts(spark, sf)[2].select("query_id", F.round("tau", 4).alias("tau"))


@register("op_w09_candidates", f"WITH {_TAU} SELECT sensor_id AS query_id, {L}::INTEGER AS len, start::BIGINT AS start, round(lb, 5) AS lb FROM lb JOIN tau USING (sensor_id) WHERE lb <= tau")
def _(spark, sf):
    _, bounds, tau = _threshold_parts(spark, sf)
    return search.candidates(bounds, tau).select("query_id", "len", "start", F.round("lb", 5).alias("lb"))


@register("op_w10_verified", _pair_sql(dtw_sql(R)))
def _(spark, sf):
    s = sensors(spark, sf)
    every = series.windows(s, L).select(F.col("sensor_id").alias("query_id"), "sensor_id", "start")
    return _verified(s)(every).select("sensor_id", "start", r6("dist", "dist"))


@register("op_w11_select", top_sql(dtw_sql(R)))
def _(spark, sf):
    s, bounds, tau = _threshold_parts(spark, sf)
    # places after the last whole window have no bound and are always verified
    tail = series.windows(s, L).select(F.col("sensor_id").alias("query_id"), "sensor_id", "start").join(bounds.select("query_id", "start"), ["query_id", "start"], "left_anti")
    chosen = search.candidates(bounds, tau).select("query_id", "sensor_id", "start").unionByName(tail)
    return shown(search.top_k(_verified(s)(chosen), ["query_id"], K))


def _index(lengths: list[int], k: int, **more):
    def run(spark, sf):
        s = sensors(spark, sf)
        found = search.index_top_k(s, latest(s, max(lengths)), lengths, k, R, W, **more)
        return found.select("query_id", "len", "start", F.col("rank").cast("long").alias("rank"), r6("dist", "dist"))

    return run


QUERIES["op_w14_exact_top_k"] = lambda spark, sf: shown(search.index_top_k(sensors(spark, sf), latest(sensors(spark, sf)), [L], K, R, W))
ORACLE_SQL["op_w14_exact_top_k"] = top_sql(dtw_sql(R))
QUERIES["op_w12_sorted_top_k"] = lambda spark, sf: shown(search.index_top_k(sensors(spark, sf), latest(sensors(spark, sf)), [L], 2 * K, R, W, mode="d2q"))
ORACLE_SQL["op_w12_sorted_top_k"] = top_sql(dtw_sql(R), 2 * K)
QUERIES["op_w13_small_chunks"] = lambda spark, sf: shown(search.index_top_k(sensors(spark, sf), latest(sensors(spark, sf)), [L], K, R, W, mode="q2d", chunk=512))
ORACLE_SQL["op_w13_small_chunks"] = top_sql(dtw_sql(R))
_LATEST = "qs AS (SELECT sensor_id AS query_id, sensor_id, n - {0} AS place, a[n - {0} + 1:n] AS q FROM p)"
QUERIES["op_w27_search_session"] = _index([16, 32, 64], K)
ORACLE_SQL["op_w27_search_session"] = f"WITH {P}, {_LATEST.format(64)}, {nearest_sql([16, 32, 64], K, 64)} {NEAREST}"
QUERIES["op_w28_retrieve_with_reserve"] = _index([16, 32], K, reserve=21, exclude=32)
ORACLE_SQL["op_w28_retrieve_with_reserve"] = f"WITH {P}, {_LATEST.format(32)}, {nearest_sql([16, 32], K, 32, 21, 32)} {NEAREST}"


_STEPS = "qs AS (SELECT sensor_id || '@' || place AS query_id, sensor_id, place, a[place + 1:place + 32] AS q FROM (SELECT sensor_id, a, unnest(range(n - 41, n - 31)) AS place FROM p))"


@register("op_w15_w18_continuous_search", f"WITH {P}, {_STEPS}, {nearest_sql([16, 32], K, 32)} {NEAREST}")
def _(spark, sf):
    """The latest queries of ten consecutive steps, each answered exactly."""
    s = sensors(spark, sf)
    n = series.lengths(s)
    starts = n.select("sensor_id", F.explode(F.sequence(F.col("n") - 32 - 9, F.col("n") - 32)).alias("start"))
    qs = q.cut_queries(s, starts, 32).select(F.concat_ws("@", "sensor_id", "start").alias("query_id"), "sensor_id", "start", "q")
    found = search.index_top_k(s, qs, [16, 32], K, R, W)
    return found.select("query_id", "len", "start", F.col("rank").cast("long").alias("rank"), r6("dist", "dist"))


@register("op_w21_merge_top_k", top_sql(EU))
def _(spark, sf):
    s = sensors(spark, sf)
    d = search.distances(s, latest(s), L)
    odd = search.top_k(d.filter(F.col("start") % 2 == 1), ["query_id", "len"], K)
    even = search.top_k(d.filter(F.col("start") % 2 == 0), ["query_id", "len"], K)
    return shown(search.merge_top_k(odd, even, K))


@register("op_w22_kth_distance", f"WITH r AS ({top_sql(EU)}) SELECT query_id, max(dist) AS tau FROM r GROUP BY query_id")
def _(spark, sf):
    s = sensors(spark, sf)
    return search.scan_top_k(s, latest(s), L, K).groupBy("query_id").agg(r6(F.max("dist"), "tau"))


@register("op_w23_strided_sample", f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t) - 1 AS rn FROM s) SELECT sensor_id, t::BIGINT AS t FROM r WHERE rn % 7 = 0 AND rn / 7 < 20")
def _(spark, sf):
    return search.strided_sample(sensors(spark, sf), ["sensor_id"], "t", 7, 20).select("sensor_id", "t")


@register("op_w24_finished", f"WITH {S} SELECT sensor_id, bool_and(v >= 0) AS finished FROM s GROUP BY sensor_id")
def _(spark, sf):
    return search.finished(sensors(spark, sf).withColumn("ok", F.col("v") >= 0), "sensor_id", "ok")


# --- top-k, sorting and scans


@register("op_t01_top_k_per_segment", f"WITH {S}, k AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) + 2 AS k FROM (SELECT DISTINCT sensor_id FROM s)), r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY v, t) AS rank FROM s) SELECT sensor_id, t::BIGINT AS t FROM r JOIN k USING (sensor_id) WHERE rank <= k")
def _(spark, sf):
    from pyspark.sql import Window

    s = sensors(spark, sf)
    ks = s.select("sensor_id").distinct().withColumn("k", F.row_number().over(Window.orderBy("sensor_id")) + 2)
    return search.top_k(s.join(F.broadcast(ks), "sensor_id"), ["sensor_id"], F.col("k"), by="v", tie="t").select("sensor_id", "t")


@register("op_t02_top_k", f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY v, t) AS rank FROM s) SELECT sensor_id, t::BIGINT AS t, v FROM r WHERE rank <= 32")
def _(spark, sf):
    return search.top_k(sensors(spark, sf), ["sensor_id"], 32, by="v", tie="t").select("sensor_id", "t", "v")


@register("op_t03_histogram", f"WITH {S}, m AS (SELECT sensor_id, min(v) AS lo, max(v) AS hi FROM s GROUP BY sensor_id) SELECT sensor_id, least(floor((v - lo) / (hi - lo) * 64), 63)::BIGINT AS bucket, count(*) AS n FROM s JOIN m USING (sensor_id) GROUP BY ALL")
def _(spark, sf):
    s = sensors(spark, sf)
    m = s.groupBy("sensor_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bucket = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 64), F.lit(63)).alias("bucket")
    return s.join(m, "sensor_id").groupBy("sensor_id", bucket).agg(F.count("*").alias("n"))


@register("op_t04_sort", f"WITH {P}, {win()} SELECT sensor_id, start::BIGINT AS start, list_sort(c) AS c FROM w")
def _(spark, sf):
    return series.windows(sensors(spark, sf), L).select("sensor_id", "start", F.sort_array("c").alias("c"))


@register("op_t05_sort_limit", f"WITH {S} SELECT sensor_id, t::BIGINT AS t, v FROM s ORDER BY v DESC, sensor_id, t LIMIT 100")
def _(spark, sf):
    return sensors(spark, sf).orderBy(F.desc("v"), "sensor_id", "t").limit(100)


@register("op_t06_aggregate", f"WITH {S} SELECT sensor_id, round(sum(v), 4) AS total, max(v) AS largest FROM s GROUP BY sensor_id")
def _(spark, sf):
    return sensors(spark, sf).groupBy("sensor_id").agg(F.round(F.sum("v"), 4).alias("total"), F.max("v").alias("largest"))


@register("op_t07_min_max", f"WITH {S} SELECT sensor_id, CASE WHEN min(v) > 0 AND min(v) < 1e-3 THEN 0 ELSE min(v) END AS low, max(v) AS high FROM s GROUP BY sensor_id")
def _(spark, sf):
    low = F.min("v")
    return sensors(spark, sf).groupBy("sensor_id").agg(F.when((low > 0) & (low < 1e-3), 0.0).otherwise(low).alias("low"), F.max("v").alias("high"))


@register("op_t08_prefix_sums", f"WITH {S} SELECT sensor_id, t::BIGINT AS t, round(sum(v) OVER w, 4) AS inclusive, round(sum(v) OVER w - v, 4) AS exclusive FROM s WINDOW w AS (PARTITION BY sensor_id ORDER BY t)")
def _(spark, sf):
    return series.prefix_sums(sensors(spark, sf)).select("sensor_id", "t", F.round("inclusive", 4).alias("inclusive"), F.round("exclusive", 4).alias("exclusive"))


@register("op_t09_order_results", f"WITH r AS ({top_sql(EU)}) SELECT query_id, start, row_number() OVER (PARTITION BY query_id ORDER BY dist DESC, start) AS place FROM r")
def _(spark, sf):
    from pyspark.sql import Window

    s = sensors(spark, sf)
    found = search.scan_top_k(s, latest(s), L, K).withColumn("dist", F.round("dist", 6))
    return found.select("query_id", "start", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dist"), "start")).cast("long").alias("place"))


# --- inverted lists

QB = f"qb AS (SELECT sensor_id AS query_id, sensor_id, unnest(range(0, {L})) AS dim, unnest(list_transform(a[n - {L} + 1:n], lambda x: trunc(x / 10)::BIGINT)) AS kw FROM p)"


def _kw(spark, sf) -> DataFrame:
    return latest(_bucketed(spark, sf)).select("query_id", "sensor_id", F.posexplode("q").alias("dim", "kw")).withColumn("kw", F.col("kw").cast("long"))


@register("op_i01_composite_keys", f"WITH {BUCKETED} SELECT sensor_id, pos::BIGINT AS pos, dim::INTEGER AS dim, ((dim << 12) + value)::BIGINT AS key, value::BIGINT AS value FROM x")
def _(spark, sf):
    rows = invlist.postings(_bucket_windows(spark, sf)).withColumn("key", invlist.composite_key(F.col("dim"), F.col("value"), 12))
    dim, value = invlist.split_key(F.col("key"), 12)
    return rows.select("sensor_id", "pos", dim.cast("int").alias("dim"), "key", value.alias("value"))


@register("op_i02_sliding_postings", f"WITH {BUCKETED} SELECT sensor_id, dim::INTEGER AS dim, value::BIGINT AS value, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    return invlist.lists(invlist.postings(_bucket_windows(spark, sf)))


@register("op_i03_disjoint_postings", f"WITH {S} SELECT sensor_id, (t // {L})::BIGINT AS pos, (t % {L})::INTEGER AS dim, trunc(v / 10)::INTEGER AS value FROM s")
def _(spark, sf):
    return invlist.disjoint_postings(series.bucketise(sensors(spark, sf), width=10.0), L)


@register("op_i04_multi_series_postings", f"WITH {S}, g AS (SELECT *, dense_rank() OVER (ORDER BY sensor_id) - 1 AS g FROM s) SELECT (g * {L} + t % {L})::BIGINT AS dim, trunc(v / 10)::INTEGER AS value, count(*) AS n FROM g GROUP BY ALL")
def _(spark, sf):
    from pyspark.sql import Window

    rows = invlist.disjoint_postings(series.bucketise(sensors(spark, sf), width=10.0), L)
    g = rows.select("sensor_id").distinct().withColumn("g", F.row_number().over(Window.orderBy("sensor_id")) - 1)
    return rows.join(F.broadcast(g), "sensor_id").select((F.col("g") * L + F.col("dim")).cast("long").alias("dim"), "value").groupBy("dim", "value").agg(F.count("*").alias("n"))


@register("op_i05_build_index", f"WITH {BUCKETED} SELECT count(*) AS entries, count(DISTINCT (sensor_id, dim, value)) AS lists FROM x")
def _(spark, sf):
    path = fresh_path(spark, "index")
    files.write_postings(invlist.postings(_bucket_windows(spark, sf)), path)
    return invlist.lists(files.read_postings(spark, path)).agg(F.sum("n").alias("entries"), F.count("*").alias("lists"))


_EXPANDED = f"{BUCKETED}, {QB}, ex AS (SELECT query_id, pos, count(*) AS count, sum((value - kw) * (value - kw))::DOUBLE AS acd FROM x JOIN qb USING (sensor_id, dim) WHERE abs(value - kw) <= 2 GROUP BY ALL)"


def _expanded(spark, sf):
    return invlist.expand(invlist.postings(_bucket_windows(spark, sf)), _kw(spark, sf), 2)


_CHOSEN = f"{BUCKETED}, {QB}, ls AS (SELECT sensor_id, dim, value, count(*) AS n FROM x GROUP BY ALL), nb AS (SELECT qb.*, value, n, sign(value - kw) AS side, coalesce(sum(n) OVER (PARTITION BY query_id, qb.dim, sign(value - kw) ORDER BY abs(value - kw) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM qb JOIN ls ON ls.sensor_id = qb.sensor_id AND ls.dim = qb.dim), ch AS (SELECT * FROM nb WHERE side = 0 OR before < 50)"


@register("op_i06_expansion", f"WITH {_CHOSEN} SELECT query_id, pos::BIGINT AS pos, count(*) AS count, sum((x.value - kw) * (x.value - kw))::DOUBLE AS acd FROM x JOIN ch ON x.sensor_id = ch.sensor_id AND x.dim = ch.dim AND x.value = ch.value GROUP BY query_id, pos")
def _(spark, sf):
    """Each dimension from its own bucket downwards and upwards until 50 entries are reached on either side."""
    rows = invlist.postings(_bucket_windows(spark, sf))
    return invlist.expand_chosen(rows, invlist.expansion(rows, _kw(spark, sf), 50)).select("query_id", "pos", "count", "acd")


@register("op_i06_frontier", f"WITH {_CHOSEN}, fr AS (SELECT query_id, dim, min(pow(value - kw, 2)) FILTER (side <> 0 AND before >= 50) AS lb, max(pow(value - kw, 2)) FILTER (side <> 0 AND before >= 50) AS ub FROM nb GROUP BY ALL) SELECT query_id, list_transform(list_sort(list(coalesce(lb, 'inf'::DOUBLE))), lambda x: CASE WHEN isinf(x) THEN -1.0 ELSE x END)::DOUBLE[] AS lbs, list_sort(list(coalesce(ub, 0)::DOUBLE)) AS ubs FROM fr GROUP BY query_id")
def _(spark, sf):
    rows = invlist.postings(_bucket_windows(spark, sf))
    shown_ = F.transform("lbs", lambda x: F.when(x == float("inf"), -1.0).otherwise(x)).alias("lbs")
    return invlist.frontier_bounds(rows, _kw(spark, sf), 50).select("query_id", shown_, "ubs")


_DIMS = "dm AS (SELECT sensor_id, dim, min(value) AS lo, max(value) AS hi FROM x GROUP BY ALL), ub AS (SELECT query_id, list(pow(greatest(kw - lo, hi - kw), 2) ORDER BY pow(greatest(kw - lo, hi - kw), 2)) AS ubs FROM qb JOIN dm USING (sensor_id, dim) GROUP BY query_id)"


@register("op_i07_dimension_bounds", f"WITH {_EXPANDED}, {_DIMS} SELECT query_id, ubs FROM ub")
def _(spark, sf):
    return invlist.dimension_bounds(invlist.postings(_bucket_windows(spark, sf)), _kw(spark, sf), 2).select("query_id", "ubs")


_BOUNDED = f"{_EXPANDED}, {_DIMS}, bo AS (SELECT query_id, pos, count, acd, acd + 9.0 * ({L} - count) AS lb, acd + coalesce(list_sum(ubs[count + 1:{L}]), 0) AS ub FROM ex JOIN ub USING (query_id))"


def _bounded(spark, sf):
    rows, kw = invlist.postings(_bucket_windows(spark, sf)), _kw(spark, sf)
    b = invlist.dimension_bounds(rows, kw, 2)
    return invlist.result_bounds(invlist.expand(rows, kw, 2), b, L), b


@register("op_i08_result_bounds", f"WITH {_BOUNDED} SELECT query_id, pos::BIGINT AS pos, lb::DOUBLE AS lb, ub::DOUBLE AS ub FROM bo")
def _(spark, sf):
    return _bounded(spark, sf)[0].select("query_id", "pos", "lb", "ub")


@register("op_i09_termination", f"WITH {_BOUNDED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ub, pos) AS rank FROM bo), a AS (SELECT query_id, max(ub) FILTER (rank <= 3) AS kth, min(lb) FILTER (rank > 3) AS rest, count(*) AS n FROM r GROUP BY query_id) SELECT query_id, n >= 3 AND kth <= least(coalesce(rest, 'inf'::DOUBLE), {9.0 * L}) AS finished FROM a")
def _(spark, sf):
    bounded, b = _bounded(spark, sf)
    return invlist.finished(bounded, b, 3, L)


_EXACT = f"{P}, {win()}, {Q}, d AS (SELECT query_id, start, list_sum(list_transform(range(1, {L + 1}), lambda i: pow(trunc(c[i] / 10) - trunc(q[i] / 10), 2))) AS dist FROM w JOIN q USING (sensor_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, start) AS rank FROM d)"


@register("op_i10_nearest", f"WITH {_EXACT} SELECT query_id, start::BIGINT AS pos, dist, rank::BIGINT AS rank FROM r WHERE rank <= 3")
def _(spark, sf):
    w = _bucket_windows(spark, sf)
    found = invlist.nearest(invlist.postings(w), w, _kw(spark, sf), 3, L)
    return found.select("query_id", "pos", "dist", F.col("rank").cast("long").alias("rank"))


@register("op_i11_point_query", f"WITH {BUCKETED}, {QB} SELECT query_id, pos::BIGINT AS pos, count(*) AS matches FROM x JOIN qb ON x.sensor_id = qb.sensor_id AND x.dim = qb.dim AND x.value = qb.kw GROUP BY ALL HAVING count(*) > 3")
def _(spark, sf):
    return invlist.point_query(invlist.postings(_bucket_windows(spark, sf)), _kw(spark, sf), 3).select("query_id", "pos", "matches")


@register("op_i12_prune_statistics", f"WITH {_EXPANDED}, e AS (SELECT sensor_id, count(DISTINCT pos) AS entries FROM x GROUP BY sensor_id) SELECT query_id, count(*) AS touched, entries, round(1 - count(*) / entries, 6) AS pruned FROM ex JOIN e ON e.sensor_id = ex.query_id GROUP BY query_id, entries")
def _(spark, sf):
    stats = invlist.prune_statistics(_expanded(spark, sf), _bucket_windows(spark, sf))
    return stats.select("query_id", "touched", "entries", r6("pruned", "pruned"))


# --- gather


def _found(spark, sf, k: int = K, reserve: int = H + 1):
    s = sensors(spark, sf)
    return s, search.scan_top_k(s, latest(s), L, k, reserve=reserve)


def _found_sql(k: int = K, ahead: int = H + 1) -> str:
    return f"{P}, {win(ahead=ahead)}, {Q}, d AS (SELECT query_id, sensor_id, start, c, y, {EU} AS dist FROM w JOIN q USING (sensor_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, start) AS rank FROM d), f AS (SELECT * FROM r WHERE rank <= {k})"


@register("op_r01_subsequences", f"WITH {_found_sql()} SELECT query_id, rank::BIGINT AS rank, c AS x FROM f")
def _(spark, sf):
    s, found = _found(spark, sf)
    return gather.subsequences(s, found, L).select("query_id", F.col("rank").cast("long").alias("rank"), "x")


@register("op_r02_values_at", f"WITH {_found_sql()} SELECT query_id, rank::BIGINT AS rank, a[start + 6] AS y FROM f JOIN p USING (sensor_id)")
def _(spark, sf):
    s, found = _found(spark, sf)
    return gather.values_at(s, found, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "y")


@register("op_r03_training_rows", f"WITH {_found_sql()} SELECT query_id, rank::BIGINT AS rank, c AS x, y FROM f")
def _(spark, sf):
    s, found = _found(spark, sf)
    rows = gather.training_rows(s, gather.subsequences(s, found, L), H)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "x", "y")


@register("op_r04_next_labels", f"WITH {_found_sql()} SELECT query_id, rank::BIGINT AS rank, h::INTEGER AS h, a[start + {L} + h + 1] AS y FROM f JOIN p USING (sensor_id), range(0, {H + 1}) t(h)")
def _(spark, sf):
    s, found = _found(spark, sf)
    out = None
    for h in range(H + 1):
        one = gather.next_labels(s, found, h).select("query_id", F.col("rank").cast("long").alias("rank"), F.lit(h).alias("h"), "y")
        out = one if out is None else out.unionByName(one)
    return out


@register("op_r05_grouped_training", f"WITH {_found_sql()} SELECT query_id, list(y ORDER BY rank) AS ys FROM f GROUP BY query_id")
def _(spark, sf):
    s, found = _found(spark, sf)
    return gather.grouped(gather.training_rows(s, found, H)).select("query_id", F.transform("train", lambda x: x.y).alias("ys"))


# --- predictors, ensemble and metrics

KS = [4, 8]
_W = "1 / (sqrt(dist) + 1e-4)"
_GRID = f"{_found_sql(8)}, gr AS (SELECT query_id, k, sum(y * {_W}) / sum({_W}) AS mean, greatest(sum(y * y * {_W}) / sum({_W}) - pow(sum(y * {_W}) / sum({_W}), 2), 0) + 1e-4 AS var FROM f, (SELECT unnest([4, 8]) AS k) z WHERE rank <= k GROUP BY ALL)"


def _grid(spark, sf):
    s, found = _found(spark, sf, 8)
    return s, forecast.knn_grid(gather.training_rows(s, found, H), KS)


@register("op_g01_knn_regression", f"WITH {_GRID} SELECT query_id, round(mean, 5) AS mean, round(var, 4) AS var FROM gr WHERE k = 8")
def _(spark, sf):
    return _grid(spark, sf)[1].filter("k = 8").select("query_id", F.round("mean", 5).alias("mean"), F.round("var", 4).alias("var"))


@register("op_g02_knn_grid", f"WITH {_GRID} SELECT query_id, k::INTEGER AS k, round(mean, 5) AS mean, round(var, 4) AS var FROM gr")
def _(spark, sf):
    return _grid(spark, sf)[1].select("query_id", "k", F.round("mean", 5).alias("mean"), F.round("var", 4).alias("var"))


@register("op_g03_row_weights", f"WITH {_found_sql()} SELECT query_id, rank::BIGINT AS rank, round(1 / (sqrt(dist) + 1), 6) AS weight FROM f")
def _(spark, sf):
    _, found = _found(spark, sf)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), r6(1 / (F.sqrt("dist") + 1), "weight"))


def _gp(spark, sf, lengths=(16,), ks=(8,)):
    s = sensors(spark, sf)
    qs = latest(s, max(lengths))
    found = search.index_top_k(s, qs, list(lengths), max(ks), R, W, reserve=H + 1)
    rows = None
    for n in lengths:
        one = gather.subsequences(s, gather.training_rows(s, found.filter(F.col("len") == n), H), n)
        rows = one if rows is None else rows.unionByName(one)
    return forecast.gp_grid(rows, qs, forecast.Settings(lengths=lengths, ks=ks, horizon=H))


@register("op_g04_loo_gp")
def _(spark, sf):
    return _gp(spark, sf)


@register("op_g06_loo_gp_grid")
def _(spark, sf):
    return _gp(spark, sf, (16, 32), (4, 8))


@register("op_g13_multi_step", f"WITH {_found_sql(8)}, ls AS (SELECT query_id, h, k, a[start + {L} + h + 1] AS y, dist FROM f JOIN p USING (sensor_id), range(0, {H + 1}) t(h), (SELECT unnest([4, 8]) AS k) z WHERE rank <= k) SELECT query_id, h::INTEGER AS h, k::INTEGER AS k, round(sum(y * {_W}) / sum({_W}), 5) AS mean FROM ls GROUP BY ALL")
def _(spark, sf):
    s, found = _found(spark, sf, 8)
    return forecast.multi_step(s, found, KS, H).select("query_id", "h", "k", F.round("mean", 5).alias("mean"))


@register("op_g14_shift_concat", f"WITH {_found_sql()} SELECT query_id, rank::BIGINT AS rank, list_append(c[2:{L}], y) AS x FROM f")
def _(spark, sf):
    s, found = _found(spark, sf)
    rows = gather.training_rows(s, gather.subsequences(s, found, L), H)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), F.concat(F.slice("x", 2, L - 1), F.array("y")).alias("x"))


@register("op_g18_sparse_gp")
def _(spark, sf):
    from ..operators.sparse import fit_predict

    return fit_predict(sensors(spark, sf), most=400, learn=True)


@register("op_g20_noise_metadata", "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'GAUSSIAN,0,' || value ELSE 'UNKNOWN' END AS m, value FROM events), g AS (SELECT avg(value) FILTER (event_id % 3 = 0) AS a FROM e) SELECT event_id, round(CASE WHEN m LIKE 'GAUSSIAN%' THEN value ELSE a END, 6) AS variance FROM e, g")
def _(spark, sf):
    from ..operators.sparse import noise_variances

    e = spark.read.parquet(f"{sf}/events.parquet")
    m = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("GAUSSIAN,0,"), F.col("value").cast("string"))).otherwise(F.lit("UNKNOWN"))
    return noise_variances(e.select("event_id", m.alias("metadata"))).select("event_id", r6("variance", "variance"))


@register("op_g22_covariances", f"WITH {P}, {win()}, {Q}, d AS (SELECT sensor_id, start, {EU} / 10000 AS d2 FROM w JOIN q USING (sensor_id)) SELECT sensor_id, start::BIGINT AS start, round(1.44 * exp(-d2 / (2 * 25)), 6) AS gaussian, round(1.2 * exp(-sqrt(d2) / 10), 6) AS exponential, round(1.2 * (1 + sqrt(5 * d2) / 5 + d2 / 15) * exp(-sqrt(5 * d2) / 5), 6) AS matern5, round(1 / 1.2, 6) AS constant FROM d")
def _(spark, sf):
    d2 = columns.squared_euclid("q", "c") / 10000
    rows = _pairs(spark, sf).select("sensor_id", "start", d2.alias("d2"))
    return rows.select("sensor_id", "start", *(r6(columns.covariance(n, F.col("d2"), 5.0, 1.2), n) for n in ("gaussian", "exponential", "matern5", "constant")))


_MIX = f"{_GRID}, mx AS (SELECT query_id, sum(mean * k) / sum(k) AS mean, sum(var * k) / sum(k) AS var FROM gr GROUP BY query_id)"


@register("op_e01_ensemble", f"WITH {_MIX} SELECT query_id, round(mean, 5) AS mean, round(var, 4) AS var FROM mx")
def _(spark, sf):
    grid = _grid(spark, sf)[1].withColumn("weight", F.col("k"))
    return forecast.ensemble(grid).select("query_id", F.round("mean", 5).alias("mean"), F.round("var", 4).alias("var"))


@register("op_e02_expert_rows", f"WITH {_GRID} SELECT query_id, list(round(mean, 5) ORDER BY k) AS means FROM gr GROUP BY query_id")
def _(spark, sf):
    g = _grid(spark, sf)[1].groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "mean"))).alias("g"))
    return g.select("query_id", F.transform("g", lambda x: F.round(x["mean"], 5)).alias("means"))


def _judged(spark, sf):
    """Each sensor's last value forecast from the queries that end just before its horizon."""
    s = sensors(spark, sf)
    past = series.trim_tail(s, H + 1)
    found = search.scan_top_k(past, latest(past), L, 8, reserve=H + 1)
    grid = forecast.knn_grid(gather.training_rows(past, found, H), KS).withColumn("weight", F.lit(0.5))
    last = s.join(series.lengths(s), "sensor_id").filter(F.col("t") == F.col("n") - 1).select(F.col("sensor_id").alias("query_id"), F.col("v").alias("y"))
    return forecast.ensemble(grid).join(last, "query_id"), grid.join(last, "query_id")


_LAST = f"{S}, p AS (SELECT sensor_id, list(v ORDER BY t) AS a0, list(v ORDER BY t)[1:count(*) - {H + 1}] AS a, count(*) - {H + 1} AS n FROM s GROUP BY sensor_id)"
_JUDGED = f"{_found_sql(8).replace(P, _LAST)}, gr AS (SELECT query_id, k, sum(y * {_W}) / sum({_W}) AS mean, greatest(sum(y * y * {_W}) / sum({_W}) - pow(sum(y * {_W}) / sum({_W}), 2), 0) + 1e-4 AS var FROM f, (SELECT unnest([4, 8]) AS k) z WHERE rank <= k GROUP BY ALL), ju AS (SELECT query_id, avg(mean) AS mean, avg(var) AS var, any_value(a0[n + {H + 1}]) AS y FROM gr JOIN p ON p.sensor_id = query_id GROUP BY query_id)"


@register("op_e03_expert_likelihood", f"WITH {_JUDGED} SELECT query_id, k::INTEGER AS k, round(exp(-pow(a0[n + {H + 1}] - mean, 2) / (2 * var)) / sqrt(2 * pi() * var), 6) AS likelihood FROM gr JOIN p ON p.sensor_id = query_id")
def _(spark, sf):
    return _judged(spark, sf)[1].select("query_id", "k", r6(columns.likelihood(F.col("y"), F.col("mean"), F.col("var")), "likelihood"))


@register("op_e06_errors", f"WITH {_JUDGED} SELECT query_id, round(abs(y - mean), 5) AS ae, round(pow(y - mean, 2), 4) AS se FROM ju")
def _(spark, sf):
    return forecast.errors(_judged(spark, sf)[0]).select("query_id", F.round("ae", 5).alias("ae"), F.round("se", 4).alias("se"))


@register("op_e07_standard_error", f"WITH {_JUDGED} SELECT query_id, round(pow(y - mean, 2) / var, 5) AS sse, round(pow(y - mean, 4) / var, 2) AS sse_compat FROM ju")
def _(spark, sf):
    j = _judged(spark, sf)[0]
    y, m, v = F.col("y"), F.col("mean"), F.col("var")
    return j.select("query_id", F.round(columns.standard_square_error(y, m, v), 5).alias("sse"), F.round(columns.standard_square_error(y, m, v, True), 2).alias("sse_compat"))


@register("op_e08_log_likelihood", f"WITH {_JUDGED} SELECT query_id, round((pow(y - mean, 2) / var + ln(var) + ln(2 * pi())) / 2, 5) AS nll FROM ju")
def _(spark, sf):
    return forecast.errors(_judged(spark, sf)[0]).select("query_id", F.round("nll", 5).alias("nll"))


@register("op_e09_metrics", f"WITH {_JUDGED} SELECT count(*) AS n, round(avg(abs(y - mean)), 5) AS mae, round(avg(pow(y - mean, 2)), 4) AS mse, round(avg(pow(y - mean, 2) / var), 5) AS msse, round(avg((pow(y - mean, 2) / var + ln(var) + ln(2 * pi())) / 2), 5) AS mnll FROM ju")
def _(spark, sf):
    m = forecast.metrics(forecast.errors(_judged(spark, sf)[0]))
    return m.select("n", F.round("mae", 5).alias("mae"), F.round("mse", 4).alias("mse"), F.round("msse", 5).alias("msse"), F.round("mnll", 5).alias("mnll"))


SMALL = forecast.Settings(lengths=(16, 32), ks=(4, 8), horizon=20, band=4, window=8, steps=10)


# ten steps are fewer than the horizon, so no truth has come back yet and the experts' weights are still equal
_TEN = "qs AS (SELECT sensor_id || '@' || step AS query_id, sensor_id, step, n - 62 + step AS place, a[n - 61 + step:n - 30 + step] AS q, a[n - 9 + step] AS y FROM p, range(0, 10) t(step))"
_FORECAST = mixed_sql(_TEN, [16, 32], [4, 8], 20, None, "n - 62")


@register("op_e10_forecast", f"{_FORECAST} SELECT query_id, sensor_id, step::INTEGER AS step, round(mean, 8) AS mean, round(var, 4) AS var, round(y, 6) AS y FROM mx JOIN qs USING (query_id)")
def _(spark, sf):
    """The flagship: 21-step-ahead forecasts of every sensor, neighbours by the index search, weights self-corrected."""
    return forecast.continuous(sensors(spark, sf), SMALL).select("query_id", "sensor_id", "step", F.round("mean", 8).alias("mean"), F.round("var", 4).alias("var"), r6("y", "y"))


@register("op_e10_forecast_gp")
def _(spark, sf):
    from dataclasses import replace

    return forecast.continuous(sensors(spark, sf), replace(SMALL, model="gp", steps=5))


@register("op_e11_forecast_metrics", f"{_FORECAST} SELECT sensor_id, count(*) AS n, round(avg(abs(y - mean)), 8) AS mae, round(avg(pow(y - mean, 2)), 3) AS mse, round(avg(pow(y - mean, 2) / var), 4) AS msse, round(avg((pow(y - mean, 2) / var + ln(var) + ln(2 * pi())) / 2), 4) AS mnll FROM mx JOIN qs USING (query_id) GROUP BY sensor_id")
def _(spark, sf):
    rows = forecast.metrics(forecast.errors(forecast.continuous(sensors(spark, sf), SMALL)), "sensor_id")
    return rows.select("sensor_id", "n", F.round("mae", 8).alias("mae"), F.round("mse", 3).alias("mse"), F.round("msse", 4).alias("msse"), F.round("mnll", 4).alias("mnll"))


@register("op_e17_etl", f"WITH {S}, m AS (SELECT * FROM s WHERE v >= 5) SELECT sensor_id, t::BIGINT AS t, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS z FROM m WINDOW w AS (PARTITION BY sensor_id)")
def _(spark, sf):
    marked = sensors(spark, sf).withColumn("v", F.when(F.col("v") < 5, -1.0).otherwise(F.col("v")))
    return series.znormalise(series.drop_missing(marked)).select("sensor_id", "t", r6("z", "z"))


# --- sessions, streams and further models


@register("op_w16_continuous_session")
def _(spark, sf):
    """Step by step over each sensor's whole history; every answer is exact."""
    from ..streaming.steps import session_steps

    return session_steps(sensors(spark, sf), SMALL).select("sensor_id", "target", "mean", "var")


@register("op_e05_stream_forecast")
def _(spark, sf):
    """The events as a stream, forecast by stateful sessions."""
    from ..streaming.stream import forecast_stream, run_available

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/event[s].parquet")
    rows = events.select(F.col("event_type").alias("sensor_id"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("v"))
    return run_available(spark, forecast_stream(rows, SMALL), "forecast")


@register("op_e04_self_correction")
def _(spark, sf):
    """Expert weights after each step of the continuous forecast."""
    from ..streaming.steps import session_steps

    weights = session_steps(sensors(spark, sf), SMALL).select("sensor_id", F.col("t").alias("step"), F.posexplode("weights").alias("expert", "weight"))
    return weights.select("sensor_id", "step", F.col("expert").cast("long").alias("expert"), "weight")


#: Neighbours in the training sets of the models below.
NEIGHBOURS = 32


def _supervised(spark, sf, schema: str, f, horizon: int = H) -> DataFrame:
    """f(sensor, x, y, at, shift, scale) on each sensor's training set: the nearest neighbours of its latest history in its
    whole history with the values `horizon` places after the next, and that latest history; all less shift, by scale."""
    s = sensors(spark, sf)
    qs = latest(s)
    found = search.index_top_k(s, qs, [L], NEIGHBOURS, R, W, reserve=horizon + 1)
    rows = gather.subsequences(s, gather.training_rows(s, found, horizon), L)
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y"))).alias("train")).join(qs.select("query_id", "q"), "query_id")

    def run(frames):
        for frame in frames:
            for sensor, train, q in zip(frame["query_id"], frame["train"], frame["q"]):
                x, y = np.array([r["x"] for r in train]), np.array([r["y"] for r in train])
                shift, scale = y.mean(), max(float(np.concatenate([x.ravel(), y]).std()), 1e-9)
                out = f(sensor, (x - shift) / scale, (y - shift) / scale, (np.asarray(q) - shift) / scale, shift, scale)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return packed.mapInPandas(run, schema)


@register("op_g05_loo_errors")
def _(spark, sf):
    from ..functions import gaussian

    def f(sensor, x, y, at, shift, scale):
        _, mean, var = gaussian.loo_terms(gaussian.np.array([3.0, 1.0, 0.7]), x, y)
        return [(sensor, float(((y - mean) ** 2 / var).mean()))]

    return _supervised(spark, sf, "sensor_id string, error double", f)


def _models(sensor, x, y, at, shift, scale):
    from ..functions import gaussian

    start = np.array([3.0, 1.0, 0.7])
    out = []
    for name, f in (("marginal", lambda p: gaussian.marginal_objective(p, x, y)), ("loo", lambda p: gaussian.loo_objective(p, x, y)), ("weighted_loo", lambda p: gaussian.weighted_loo_objective(p, x, y, at))):
        p, value = gaussian.scg(f, start, 5)
        m, v = gaussian.predict(p, x, y, at[None])
        out.append((sensor, name, float(value), float(m[0]) * scale + shift, float(v[0]) * scale**2))
    return out


@register("op_g07_marginal_gp")
def _(spark, sf):
    return _supervised(spark, sf, "sensor_id string, model string, objective double, mean double, var double", _models).filter("model = 'marginal'")


@register("op_g08_weighted_loo_gp")
def _(spark, sf):
    return _supervised(spark, sf, "sensor_id string, model string, objective double, mean double, var double", _models).filter("model = 'weighted_loo'")


@register("op_g09_gp_predict")
def _(spark, sf):
    return _supervised(spark, sf, "sensor_id string, model string, objective double, mean double, var double", _models).filter("model = 'loo'")


@register("op_g10_iterative_gp")
def _(spark, sf):
    """Five steps ahead one after the other, each prediction's uncertainty going into the next input."""
    from ..functions import gaussian

    def f(sensor, x, y, at, shift, scale):
        p, _ = gaussian.scg(lambda z: gaussian.loo_objective(z, x, y), np.array([3.0, 1.0, 0.7]), 5)
        mean, cov, out = at.copy(), 1e-9 * np.eye(len(at)), []
        for step in range(5):
            m, v, cross = gaussian.predict_uncertain(p, x, y, mean, cov)
            out.append((sensor, step, m * scale + shift, max(v, 1e-9) * scale**2))
            mean, cov = gaussian.next_input(mean, cov, m, max(v, 1e-9), cross)
        return out

    return _supervised(spark, sf, "sensor_id string, step long, mean double, var double", f, horizon=0)


@register("op_g17_sparse_evidence")
def _(spark, sf):
    from ..functions.gaussian import SparseGp

    def f(sensor, x, y, at, shift, scale):
        m = SparseGp([("gaussian", np.array([3.0, 1.0]))], 0.5, 20).fit(x, y)
        mean, var = m.predict(at[None])
        return [(sensor, m.evidence(), m.evidence("upper"), float(mean[0]) * scale + shift, float(var[0]) * scale**2)]

    return _supervised(spark, sf, "sensor_id string, evidence double, upper double, mean double, var double", f)


@register("op_g24_trainer")
def _(spark, sf):
    from ..functions import gaussian

    def f(sensor, x, y, at, shift, scale):
        p, value = gaussian.scg(lambda z: gaussian.loo_objective(z, x, y), np.array([3.0, 1.0, 0.7]), 30)
        return [(sensor, *map(float, p), value)]

    return _supervised(spark, sf, "sensor_id string, length double, sf double, sn double, objective double", f)


_WHOLE = 32 + 20 + 1
_SAMPLED = f"qs AS (SELECT sensor_id || '@' || place AS query_id, sensor_id, place, a[place + 1:place + 32] AS q, a[place + {_WHOLE}] AS y FROM (SELECT sensor_id, a, i * ((n - {2 * _WHOLE} - 1) // 4) + {_WHOLE} AS place FROM p, range(0, 4) t(i)))"


@register("op_e11_leave_out_experiment", experiment_sql(_SAMPLED, [16, 32], [4, 8], 20, _WHOLE, "n"))
def _(spark, sf):
    from ..api import leave_out_experiment

    return judged(leave_out_experiment(sensors(spark, sf), 4, SMALL))


# --- variants, helpers and drivers


@register("op_k07_scan_l1", top_sql(L1))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.scan_top_k(s, latest(s), L, K, "l1"))


@register("op_k07_scan_vanilla", top_sql(dtw_sql(None)))
def _(spark, sf):
    s = sensors(spark, sf)
    return shown(search.scan_top_k(s, latest(s), L, K, "vanilla"))


@register("op_d06_dtw_symmetric", _pair_sql(dtw_sql(R)))
def _(spark, sf):
    """Banded DTW with the arguments swapped: the same value."""
    return _pairs(spark, sf).select("sensor_id", "start", r6(columns.dtw(F.col("c"), F.col("q"), R), "dist"))


@register("op_d07_dtw_matrix", _pair_sql(dtw_sql(R)))
def _(spark, sf):
    """Banded DTW by the vectorised kernel, over Arrow batches."""
    from ..functions import kernels

    @F.pandas_udf("double")
    def dist(qs: pd.Series, cs: pd.Series) -> pd.Series:
        q, c = np.stack(qs.to_numpy()), np.stack(cs.to_numpy())
        out = np.empty(len(q))
        first, group = np.unique(q, axis=0, return_inverse=True)
        for i, one in enumerate(first):
            out[group == i] = kernels.dtw(one, c[group == i], R)
        return pd.Series(out)

    return _pairs(spark, sf).select("sensor_id", "start", r6(dist("q", "c"), "dist"))


@register("op_d15_metrics_together", f"WITH {P}, {win()}, {Q} SELECT sensor_id, start::BIGINT AS start, round({EU}, 6) AS euclid, round({L1}, 6) AS l1, round({dtw_sql(R)}, 6) AS dtw FROM w JOIN q USING (sensor_id)")
def _(spark, sf):
    return _pairs(spark, sf).select("sensor_id", "start", *(r6(search.METRICS[m](F.col("q"), F.col("c"), R), m) for m in ("euclid", "l1", "dtw")))


@register("op_s16_file_names", "SELECT event_type || '.csv' AS data, event_type || '_d16_q20_dir.query' AS query, event_type || '_ql16_gqn20_group.query' AS \"group\" FROM events GROUP BY event_type")
def _(spark, sf):
    kinds = sensors(spark, sf).select(F.col("sensor_id").alias("k")).distinct()
    names = files.file_names("@", L, 20)
    return kinds.select(*(F.regexp_replace(F.lit(v), "@", F.col("k")).alias(n) for n, v in names.items()))


@register("op_q11_geometric_grid", "SELECT len::INTEGER AS len, k::INTEGER AS k FROM (SELECT unnest([8, 16, 32, 64]) AS len), (SELECT unnest([4, 8, 16, 32]) AS k)")
def _(spark, sf):
    lengths, ks = q.geometric_grid(64, 32)
    return spark.range(1).select(F.explode(F.array(*map(F.lit, lengths))).alias("len")).select("len", F.explode(F.array(*map(F.lit, ks))).alias("k"))


@register("op_w07_bound_pipeline", f"WITH {_windows_sql('both')}, {GROUP} SELECT sensor_id, len::INTEGER AS len, start::BIGINT AS start, round(d, 5) AS d2q, round(e, 5) AS q2d FROM g WHERE c = tiles")
def _(spark, sf):
    s, b = _bounds(spark, sf)
    ends = series.lengths(s)
    one = search.group_bounds(b, ends, 32, [16, 32], W, "d2q").withColumnRenamed("lb", "d2q")
    two = search.group_bounds(b, ends, 32, [16, 32], W, "q2d").withColumnRenamed("lb", "q2d")
    return one.join(two, ["query_id", "sensor_id", "len", "start"]).select("sensor_id", "len", "start", F.round("d2q", 5).alias("d2q"), F.round("q2d", 5).alias("q2d"))


@register("op_w17_threshold_from_last_step", f"WITH {P}, {win()}, q0 AS (SELECT sensor_id, n, a[n - {L}:n - 1] AS q FROM p), d0 AS (SELECT sensor_id, start, {EU} AS dist FROM w JOIN q0 USING (sensor_id) WHERE start < n - {L}), r0 AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY dist, start) AS rank FROM d0), {Q} SELECT sensor_id, round(max({EU}), 6) AS tau FROM r0 JOIN w USING (sensor_id, start) JOIN q USING (sensor_id) WHERE rank <= {K} GROUP BY sensor_id")
def _(spark, sf):
    """The winners of the step before against the new query: a valid threshold."""
    s = sensors(spark, sf)
    before = search.scan_top_k(series.trim_tail(s, 1), latest(s, L, 1), L, K)
    again = gather.subsequences(s, before.select("sensor_id", "start"), L).join(latest(s).select("sensor_id", "item"), "sensor_id")
    return again.groupBy("sensor_id").agg(r6(F.max(columns.squared_euclid(F.col("item"), F.col("x"))), "tau"))


@register("op_g12_iterative_forecast")
def _(spark, sf):
    """Four steps of the iterative (length, k) grid: each expert's prediction enters its next input with its variance, and
    its training rows move on by one place."""
    s, settings = sensors(spark, sf), forecast.Settings(lengths=(16, 32), ks=(8, 16), band=R, window=W, start=(3.0, 1.0, 0.7))
    qs = latest(s, 32)
    found = search.index_top_k(s, qs, [16, 32], 16, R, W, reserve=4)
    return forecast.iterative_grid(s, found, qs, settings, 4)


@register("op_g15_robust_inverse")
def _(spark, sf):
    """Residual of the jittered inverse of each sensor's covariance matrix."""
    from ..functions import gaussian

    def f(sensor, x, y, at, shift, scale):
        k = gaussian.covariance("gaussian", x, x, np.array([3.0, 1.0])) + 0.01 * np.eye(len(x))
        return [(sensor, float(np.abs(k @ gaussian.inverse(k) - np.eye(len(x))).max()))]

    return _supervised(spark, sf, "sensor_id string, residual double", f)


@register("op_g21_likelihood_update", f"WITH {_JUDGED} SELECT query_id, round(-1 / (var + 4), 6) AS r, round((y - mean) / (var + 4), 6) AS q, round(-(ln(2 * pi() * (var + 4)) + pow(y - mean, 2) / (var + 4)) / 2, 5) AS log_evidence FROM ju")
def _(spark, sf):
    """Gaussian likelihood with noise 4: first and second derivative of the log evidence, and the log evidence."""
    total, e = F.col("var") + 4, F.col("y") - F.col("mean")
    return _judged(spark, sf)[0].select("query_id", r6(-1 / total, "r"), r6(e / total, "q"), F.round(-(F.log(2 * F.pi() * total) + e * e / total) / 2, 5).alias("log_evidence"))


@register("op_g23_gram_matrix", f"WITH {P}, g AS (SELECT sensor_id, a[n - 20:n] AS x FROM p), i AS (SELECT sensor_id, x, unnest(range(1, 22)) AS i FROM g) SELECT sensor_id, i::INTEGER AS i, j::INTEGER AS j, round(1.44 * exp(-pow((x[i] - x[j]) / 50, 2) / 2), 6) AS k FROM i, range(1, 22) t(j)")
def _(spark, sf):
    """Covariances of each sensor's last 21 values."""
    x = q.latest(sensors(spark, sf), 21).select("sensor_id", F.posexplode("q").alias("i", "a"), "q").select("sensor_id", (F.col("i") + 1).alias("i"), "a", F.posexplode("q").alias("j", "b"))
    d2 = F.pow((F.col("a") - F.col("b")) / 50, 2)
    return x.select("sensor_id", "i", (F.col("j") + 1).alias("j"), r6(columns.covariance("gaussian", d2, 1.0, 1.2), "k"))


@register("op_g25_gradient_check")
def _(spark, sf):
    """Largest difference of the analytic and the numerical gradient of the leave-one-out objective."""
    from ..functions import gaussian

    def f(sensor, x, y, at, shift, scale):
        p = np.array([3.0, 1.0, 0.7])
        return [(sensor, float(np.abs(gaussian.loo_objective(p, x, y)[1] - gaussian.numerical_gradient(lambda z: gaussian.loo_objective(z, x, y)[0], p)).max()))]

    return _supervised(spark, sf, "sensor_id string, difference double", f)


@register("op_g26_trainer_on_parabola")
def _(spark, sf):
    """The trainer on a parabola whose minimum is each sensor's mean and deviation."""
    from ..functions import gaussian

    def run(frames):
        for frame in frames:
            out = []
            for sensor, *target in zip(frame["sensor_id"], frame["mean"], frame["deviation"]):
                at = np.array(target)
                p, value = gaussian.scg(lambda z: (float(((z - at) ** 2).sum()), 2 * (z - at)), np.zeros(2), 30)
                out.append((sensor, float(np.abs(p - at).max()), value))
            yield pd.DataFrame(out, columns=["sensor_id", "distance", "value"])

    return series.mean_deviation(sensors(spark, sf)).mapInPandas(run, "sensor_id string, distance double, value double")


@register("op_s19_estimate_parameters")
def _(spark, sf):
    from ..api import estimate_parameters, gp_predict

    def f(sensor, x, y, at, shift, scale):
        p = estimate_parameters(x, y, (3.0, 1.0, 0.7), 10)
        m, v = gp_predict(p, x, y, at[None])
        return [(sensor, float(m[0]) * scale + shift, float(v[0]) * scale**2)]

    return _supervised(spark, sf, "sensor_id string, mean double, var double", f)


@register("op_e12_search_profile")
def _(spark, sf):
    """How many places each query's search verified, of all it could have."""
    s = sensors(spark, sf)
    found = search.index_profile(s, latest(s, 32), [16, 32], K, R, W)
    return found.select("query_id", "len", "verified", "places")


_LAST_TEN = f"qs AS (SELECT sensor_id || '@' || place AS query_id, sensor_id, place, a[place + 1:place + 32] AS q, a[place + {_WHOLE}] AS y FROM (SELECT sensor_id, a, unnest(range(n - {_WHOLE} - 9, n - {_WHOLE} + 1)) AS place FROM p))"


@register("op_e13_sequential_experiment", experiment_sql(_LAST_TEN, [16, 32], [4, 8], 20, None, f"n - {_WHOLE + 9}"))
def _(spark, sf):
    """Forecasts from overlapping queries, one after the other, judged on the value that came."""
    from ..api import sequential_experiment

    return judged(sequential_experiment(sensors(spark, sf), 10, SMALL))


@register("op_stream_tumbling", "SELECT event_type AS sensor_id, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(spark, sf):
    """Event-time windows of a day over the stream of events; the last ones are closed by reading all that is there."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = events.select(F.col("event_type").alias("sensor_id"), F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "value")
    return rows.groupBy("sensor_id", F.col("w.start").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))
