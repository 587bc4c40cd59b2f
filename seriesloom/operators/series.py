"""Series as rows (sensor_id, t, v): indexing, normalisation, bucketing, chunking and leave-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_series(df: DataFrame, sensor: str, ts: str, value: str, tie: str, width: str = "day") -> DataFrame:
    """sensor_id, t, v: each sensor's values numbered by time (ties by `tie`) from 0.

    Rows are numbered inside calendar buckets, and each bucket starts at the count of the sensor's earlier ones, so no
    task sorts a whole sensor; only the small table of bucket counts is windowed per sensor.
    """
    rows = df.select(F.col(sensor).cast("string").alias("sensor_id"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("v"), F.date_trunc(width, F.col(ts)).alias("bucket"))
    counts = rows.groupBy("sensor_id", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sensor_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sensor_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    here = F.row_number().over(Window.partitionBy("sensor_id", "bucket").orderBy("ts", "tie"))
    numbered = rows.select("sensor_id", "bucket", "v", here.alias("i"))
    return numbered.join(starts, ["sensor_id", "bucket"]).select("sensor_id", (F.col("start") + F.col("i") - 1).alias("t"), "v")


def per_sensor(sensors: list[str] | None = None):
    return Window.partitionBy(*(sensors or ["sensor_id"]))


def znormalise(series: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds z: (v - mean) / population deviation * scale, per sensor. The statistics are aggregated map-side and joined
    back, so a long sensor is never gathered."""
    stats = mean_deviation(series)
    return series.join(stats, "sensor_id").select(*series.columns, ((F.col("v") - F.col("mean")) / F.col("deviation") * scale).alias("z"))


def mean_deviation(series: DataFrame) -> DataFrame:
    return series.groupBy("sensor_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


def drop_missing(series: DataFrame, marker: float = -1.0) -> DataFrame:
    """Rows whose value isn't the marker; null values go as well."""
    return series.filter(F.col("v") != marker)


def bucket_width(series: DataFrame, n: int) -> DataFrame:
    """sensor_id, width of n equal buckets from the least to the largest value."""
    return series.groupBy("sensor_id").agg(((F.max("v") - F.min("v")) / (n - 1)).alias("width"))


def bucketise(series: DataFrame, width: float | None = None, n: int | None = None) -> DataFrame:
    """Adds bucket: v / width cut towards zero, the width given or from n buckets per sensor."""
    if width is not None:
        return series.withColumn("bucket", (F.col("v") / width).cast("int"))
    return series.join(bucket_width(series, n), "sensor_id").withColumn("bucket", (F.col("v") / F.col("width")).cast("int")).drop("width")


def keyword(v: Column, width: float) -> Column:
    """Bucket of a value: rounded for width 1, else cut."""
    return (v + 0.5).cast("int") if width == 1 else (v / width).cast("int")


def keyword_edges(k: Column, width: float) -> tuple[Column, Column]:
    """First and last value of a bucket: inclusive start and exclusive end; for width 1 the value itself."""
    if width == 1:
        return k.cast("double"), k.cast("double")
    return k * F.lit(width), (k + 1) * F.lit(width)


def frame(series: DataFrame, before: int, after: int, chunk: int = 1 << 14) -> DataFrame:
    """Series in chunks of `chunk` places, each with copies of its neighbours' places within reach: sensor_id, chunk,
    first (place of values[0]), values. Row frames over a chunk see all they need, and a long sensor is spread out."""
    low = F.floor((F.col("t") - before) / chunk)
    high = F.floor((F.col("t") + after) / chunk)
    last = F.floor(F.col("t") / chunk)
    spread = series.select("sensor_id", "t", "v", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, last))).alias("chunk"))
    packed = spread.groupBy("sensor_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    # chunks that hold borrowed places alone have no place of their own
    own = F.exists("p", lambda x: F.floor(x.t / chunk) == F.col("chunk"))
    return packed.filter(own).select("sensor_id", "chunk", F.element_at("p", 1).t.alias("first"), F.transform("p", lambda x: x.v).alias("values"))


def windows(series: DataFrame, length: int, chunk: int = 1 << 14, ahead: int = 0) -> DataFrame:
    """sensor_id, start, c (array of `length` values) and, with ahead > 0, y (the value `ahead` places after the last):
    every subsequence that fits. Subsequences are sliced from chunks, whose overlap alone is shuffled."""
    f = frame(series, length - 1 + ahead, 0, chunk)
    fits = F.sequence(F.lit(0), F.size("values") - length - ahead)
    starts = F.when(F.size("values") >= length + ahead, F.filter(fits, lambda i: F.floor((i + F.col("first")) / chunk) == F.col("chunk")))
    rows = f.select("sensor_id", "first", "values", F.explode(starts).alias("i"))
    out = [F.col("sensor_id"), (F.col("first") + F.col("i")).alias("start"), F.slice("values", F.col("i") + 1, length).alias("c")]
    if ahead:
        out.append(F.element_at("values", (F.col("i") + length + ahead).cast("int")).alias("y"))
    return rows.select(*out)


def envelopes(series: DataFrame, r: int, chunk: int = 1 << 14) -> DataFrame:
    """sensor_id, t, v, up, lo: distances from v up to the largest and down to the least value within r places."""
    f = frame(series, r, r, chunk)
    at = F.transform("values", lambda x, i: F.struct((F.col("first") + i).alias("t"), x.alias("v"), F.slice("values", F.greatest(i - r, F.lit(0)) + 1, F.least(i + r, F.size("values") - 1) - F.greatest(i - r, F.lit(0)) + 1).alias("near")))
    rows = f.select("sensor_id", "chunk", F.explode(at).alias("x")).select("sensor_id", "chunk", "x.*").filter(F.floor(F.col("t") / chunk) == F.col("chunk"))
    return rows.select("sensor_id", "t", "v", (F.array_max("near") - F.col("v")).alias("up"), (F.col("v") - F.array_min("near")).alias("lo"))


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("sensor_id").agg((F.max("t") + 1).alias("n"))


def trim_tail(series: DataFrame, places: int) -> DataFrame:
    """Each sensor without its last places."""
    return series.join(lengths(series), "sensor_id").filter(F.col("t") < F.col("n") - places).drop("n")


def leave_out(series: DataFrame, cuts: DataFrame, length: int) -> DataFrame:
    """query_id, sensor_id, t, v: for every cut (query_id, sensor_id, start) the sensor without the places from
    max(start - length, 0) to start + length, the two sides spliced together and numbered anew."""
    low, high = F.greatest(F.col("start") - length, F.lit(0)), F.col("start") + length
    rows = series.join(cuts, "sensor_id").filter((F.col("t") < low) | (F.col("t") >= high))
    return rows.select("query_id", "sensor_id", F.when(F.col("t") < low, F.col("t")).otherwise(F.col("t") - (high - low)).alias("t"), "v")


def replicate(series: DataFrame, n: int) -> DataFrame:
    """Every series n times, as sensors sensor_id#0 to sensor_id#(n - 1)."""
    return series.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "sensor_id", "t", "v").select(F.concat_ws("#", "sensor_id", "i").alias("sensor_id"), "t", "v")


def prefix_sums(series: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """series with inclusive and exclusive running sums per sensor: sums inside chunks, plus each chunk's sum of all
    earlier ones, so no task walks a whole sensor."""
    rows = series.withColumn("chunk", F.floor(F.col("t") / chunk))
    totals = rows.groupBy("sensor_id", "chunk").agg(F.sum("v").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("sensor_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    here = F.sum("v").over(Window.partitionBy("sensor_id", "chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("here", here).join(totals.select("sensor_id", "chunk", before.alias("before")), ["sensor_id", "chunk"])
    return out.select("sensor_id", "t", "v", (F.col("before") + F.col("here")).alias("inclusive"), (F.col("before") + F.col("here") - F.col("v")).alias("exclusive"))
