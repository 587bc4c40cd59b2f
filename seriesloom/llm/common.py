"""Helpers shared by the text operators: shared-storage staging, Arrow access, ordered group streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on at a time; it bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20
#: The same for passes that keep several numbers for each byte.
FINE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset and the master is local, as in
    tests) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_seriesloom_dir", None)
        if at is None:
            at = spark.sparkContext._seriesloom_dir = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
    return at.rstrip("/")


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table. createDataFrame would make it of Python rows, for whose stage every executor starts a second Python
    daemon with workers of its own, and keeps them."""
    return spark.range(1).filter("false").select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seriesloom/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged table once nothing reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def stage(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: cuts the lineage and survives lost executors.
    group_rows: most rows of a row group, all of which a writer and a reader hold at once; Parquet itself looks at the
    size only after a hundred rows."""
    path = fresh_path(df.sparkSession, name)
    write = df.write.option("compression", "zstd")
    if group_rows:
        write = write.option("parquet.block.row.count.limit", str(group_rows))
    write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    for df in frames:
        if path := getattr(df, "staged_path", None):
            drop_path(df.sparkSession, path)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that begins with `name` and that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column in one uint8 array, and its int64 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    n, at = len(col), col.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[at : at + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges that hold about `size` bytes each (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES):
    """(rows, bytes, offsets) of each piece of each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = byte_view(batch.column(column))
        for i, j in pieces(offsets, size):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES):
    """(batch, pieces) with pieces (row, text, first, last) of about `size` bytes together: the texts of a batch in order, a
    longer one in several pieces that end between two characters. Nulls are empty texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = byte_view(batch.column(column))
        out, held = [], 0
        for row, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            at = a
            while True:
                end = min(z, at + max(size - held, 4))
                while end < z and data[end] & 0xC0 == 0x80:
                    end -= 1
                if end < z and z - a <= size and at == a:  # a text of one piece isn't cut to fill up another's
                    yield batch, out
                    out, held = [], 0
                    continue
                out.append((row, data[at:end].tobytes().decode(), at == a, end == z))
                held += end - at
                at = end
                if held >= size:
                    yield batch, out
                    out, held = [], 0
                if at >= z:
                    break
        if out:
            yield batch, out


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from packed bytes and byte offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def ordered_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a partition that is sorted by them; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        edges = [0, *starts, batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, n: int, keys: list[str], f: Callable, schema: str) -> DataFrame:
    """Deals rows out by `keys`, sorts each partition by them and maps its runs; f gets an iterator of tables."""

    def run(batches):
        yield from f(ordered_groups(batches, keys))

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_filter(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """`bits` flags (a power of two), set at the lower part of each of the 64-bit numbers in a column. The size is fixed,
    however many there are; what passes wrongly finds no partner when it is joined."""
    n = F.col(column).bitwiseAND(F.lit(bits - 1))  # added up on the executors, so a word of flags is collected once
    found = ids.select(n.alias("n")).groupBy(F.shiftright("n", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(n & 63 as int)))").alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("x").to_numpy()
    return out


def flagged(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the flags `at` (numbers not negative) are set; the filter stays packed, a bit a flag."""
    return (words.astype("<i8", copy=False).view(np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) != 0


def arrow_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and bytes, so that very long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
