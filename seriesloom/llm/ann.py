"""Nearest neighbours by a block matrix join with int8 tiles and quantisation error bounds.

1. Vectors are packed into blocks, each vector as int8 codes with its own scale and the exact norm of its rounding error;
   the original components stay beside them and aren't read until step 3.
2. Panels of query blocks meet groups of candidate blocks on codes alone, so a candidate is sent once per panel and not
   once per query block. A tile's int8 product gives the distance of the quantised vectors; the true distance differs by at
   most the sum of both errors. The k smallest upper bounds that a query has seen are kept from tile to tile; a pair whose
   lower bound exceeds the largest of them is dropped. The k smallest upper bounds over all tasks then drop more.
3. Survivors go to their candidate block and are recomputed in double precision on the original components.
4. A heap per query merges what all blocks have found. The result is exact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, shuffle_partitions, stage, unstage

BLOCK = "dim int, n int, ids binary, codes binary, scale binary, error binary, raw binary"


@dataclass(frozen=True)
class Settings:
    """k: neighbours. query_block, block: most vectors of a query block and of a candidate block. panel: query blocks that
    a task holds, and candidate blocks that pass by them, on average."""

    k: int = 10
    query_block: int = 1024
    block: int = 2048
    panel: int = 64


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding array<double> of vectors that take part: not null, not zero, all components finite."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("embedding")).filter("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter(~bad & F.exists("embedding", lambda v: v != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and the norm of the rounding error of each row (rounded up)."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes.astype(np.int8), scale, error * (1 + 1e-9) + 1e-300


def pack(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` vectors of one dimension."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim, parts):
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            codes, scale, error = quantise(x)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, codes, scale, error, x))], names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
            lens = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lens)])
            for dim in np.unique(lens).tolist():
                rows = np.flatnonzero(lens == dim)
                x = values[at[rows][:, None] + np.arange(dim)]
                for a in range(0, len(rows), size):
                    held.setdefault(dim, []).append((ids[rows[a : a + size]], x[a : a + size]))
                    if sum(len(p[0]) for p in held[dim]) >= size:
                        yield out(dim, held.pop(dim))
        for dim, parts in held.items():
            yield out(dim, parts)

    return vectors.mapInArrow(run, BLOCK)


class Block:
    """A block's ids and codes; index i of a batch of blocks."""

    def __init__(self, t: pa.RecordBatch, i: int):
        get = lambda c: t.column(c)[i].as_py()
        n, dim = get("n"), get("dim")
        self.number, self.ids = get("number"), np.frombuffer(get("ids"), np.int64)
        self.codes = np.frombuffer(get("codes"), np.int8).reshape(n, dim)
        self.scale, self.error = np.frombuffer(get("scale")), np.frombuffer(get("error"))

    @property
    def square(self) -> np.ndarray:
        return (self.codes.astype(np.float64) ** 2).sum(1) * self.scale**2


def bounds(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances of a tile."""
    dtype = np.float32 if q.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay exact
    dot = (q.codes.astype(dtype) @ c.codes.astype(dtype).T).astype(np.float64)
    near = np.sqrt(np.maximum(q.square[:, None] + c.square[None] - 2 * dot * q.scale[:, None] * c.scale[None], 0))
    slack = q.error[:, None] + c.error[None] + 1e-6 * (1 + near) * np.maximum(q.scale[:, None], c.scale[None])
    return near - slack, near + slack


def tile(q: Block, c: Block, best: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(query's place, candidate's place, lower, upper) of the pairs that may be among the nearest, and the new best: each
    query's k smallest upper bounds so far (infinite where it has seen fewer). A query's own id is never a candidate."""
    lower, upper = bounds(q, c)
    other = q.ids[:, None] != c.ids[None]
    k = best.shape[1]
    best = np.partition(np.concatenate([best, np.where(other, upper, np.inf)], axis=1), k - 1, axis=1)[:, :k]
    qi, ci = np.nonzero(other & (lower <= best.max(1)[:, None]))
    return (qi, ci, lower[qi, ci], upper[qi, ci]), best


SURVIVORS = "q long, qi int, c long, ci int, lower double, upper double"


def _tiles(qb: DataFrame, cb: DataFrame, s: Settings) -> DataFrame:
    """Each panel of query blocks in a task, past which a group of candidate blocks goes one by one."""
    n = shuffle_partitions(qb.sparkSession)
    codes = ["number", "dim", "n", "ids", "codes", "scale", "error"]
    a = F.ceil(F.col("nq") / s.panel).cast("int")
    b = F.greatest(F.ceil(F.col("nc") / s.panel), F.least(F.col("nc"), F.ceil(F.lit(2 * n) / F.col("a")))).cast("int")
    sizes = qb.groupBy("dim").agg(F.count("*").alias("nq")).join(cb.groupBy("dim").agg(F.count("*").alias("nc")), "dim").withColumn("a", a).select("dim", "a", b.alias("b"))
    deal = lambda parts: F.pmod(F.xxhash64("number"), parts).cast("int")
    all_ = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    queries = qb.select(*codes).join(sizes, "dim").select(*codes, deal(F.col("a")).alias("g"), all_("b").alias("h"), F.lit(0).alias("kind"))
    candidates = cb.select(*codes).join(sizes, "dim").select(*codes, deal(F.col("b")).alias("h"), all_("a").alias("g"), F.lit(1).alias("kind"))
    dealt = queries.unionByName(candidates).repartition(n, "dim", "g", "h").sortWithinPartitions("dim", "g", "h", "kind", "number")

    def run(batches):
        key, panel = None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("dim", "g", "h", "kind")))
            for i, (*now, kind) in enumerate(rows):
                if now != key:
                    key, panel = now, []
                block = Block(batch, i)
                if kind == 0:
                    panel.append([block, np.full((len(block.ids), s.k), np.inf)])
                    continue
                for held in panel:
                    (qi, ci, lower, upper), held[1] = tile(held[0], block, held[1])
                    if len(qi):
                        same = [pa.array(np.full(len(qi), x, np.int64)) for x in (held[0].number, block.number)]
                        yield pa.RecordBatch.from_arrays([same[0], pa.array(qi.astype(np.int32)), same[1], pa.array(ci.astype(np.int32)), pa.array(lower), pa.array(upper)], names=["q", "qi", "c", "ci", "lower", "upper"])

    return dealt.mapInArrow(run, SURVIVORS)


def _query_rows(qb: DataFrame) -> DataFrame:
    """q, qi, query_id, x (its components): the queries one by one."""

    def run(batches):
        for batch in batches:
            for q, n, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("number", "n", "ids", "raw"))):
                width = len(raw) // n
                x = [raw[i : i + width] for i in range(0, len(raw), width)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(ids, np.int64)), pa.array(x, pa.binary())], names=["q", "qi", "query_id", "x"])

    return qb.select("number", "n", "ids", "raw").mapInArrow(run, "q long, qi int, query_id long, x binary")


def _best(q: np.ndarray, v: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k nearest."""
    order = np.lexsort((v, d, q))
    first = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _distances(pairs: DataFrame, cb: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the surviving pairs (c, ci, query_id, x), which pass by their candidate block; of many
    that tie in a block only the k nearest go on."""
    blocks = cb.select(F.col("number").alias("c"), F.lit(-1).alias("ci"), F.lit(None).cast("long").alias("query_id"), F.col("raw").alias("x"), "ids")
    rows = blocks.unionByName(pairs.withColumn("ids", F.lit(None).cast("binary")))
    dealt = rows.repartition(shuffle_partitions(cb.sparkSession), "c").sortWithinPartitions("c", "ci")

    def run(batches):
        ids = x = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ci = batch.column("ci").to_numpy()
            heads = np.flatnonzero(ci < 0).tolist()
            for a, z in zip([-1, *heads], [*heads, len(ci)]):
                if a >= 0:
                    ids = np.frombuffer(batch.column("ids")[a].as_py(), np.int64)
                    x = np.frombuffer(batch.column("x")[a].as_py()).reshape(len(ids), -1)
                if z - a > 1:
                    part, at = batch.slice(a + 1, z - a - 1), ci[a + 1 : z]
                    q = np.frombuffer(b"".join(part.column("x").to_pylist())).reshape(len(at), -1)
                    score = np.sqrt(np.cumsum((x[at] - q) ** 2, axis=1)[:, -1])  # added in component order
                    query = part.column("query_id").to_numpy()
                    few = _best(query, ids[at], score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x[few]) for x in (query, ids[at], score)], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, by a heap whose top is the farthest of them."""
    dealt = found.repartition(shuffle_partitions(found.sparkSession), "query_id").sortWithinPartitions("query_id")

    def out(query, heap):
        best = sorted((-d, -v) for d, v in heap)
        return [(query, r + 1, v, d) for r, (d, v) in enumerate(best)]

    def run(batches):
        query, heap, done = None, [], []
        for batch in batches:
            for q, v, d in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
                if q != query:
                    done += out(query, heap)
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -v))
                elif (-d, -v) > heap[0]:
                    heapq.heapreplace(heap, (-d, -v))
            if len(done) > 10_000:
                yield _ranked(done)
                done = []
        done += out(query, heap)
        if done:
            yield _ranked(done)

    return dealt.mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def _ranked(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["query_id", "rank", "vec_id", "score"])


def nearest(queries: DataFrame, vectors: DataFrame, s: Settings | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest vectors by Euclidean distance.

    Vectors that are null, zero or hold null or non-finite components take no part, as queries or candidates; only
    vectors of one length are compared. A query's own vec_id is no candidate, under any of its rows. Ties go to the
    smaller vec_id; repeated rows count as rows, and the rows of a repeated query give one list together. Fewer candidates
    than k: all of them. Other columns are ignored; empty tables give an empty result.
    """
    s = s or Settings()
    spark = queries.sparkSession
    arrow_batches(spark)
    number = F.monotonically_increasing_id()
    cb = stage(pack(valid(vectors), s.block).withColumn("number", number), "vector-blocks")
    qb = stage(pack(valid(queries).repartition(1 + queries.count() // s.query_block), s.query_block).withColumn("number", number), "query-blocks")
    seen = stage(_tiles(qb, cb, s), "tile-survivors")
    rank = F.row_number().over(Window.partitionBy("q", "qi").orderBy("upper"))
    tau = seen.select("q", "qi", "upper").withColumn("r", rank).filter(F.col("r") <= s.k).groupBy("q", "qi").agg(F.max("upper").alias("tau"), F.count("*").alias("n"))
    tau = stage(tau.filter(F.col("n") >= s.k).select("q", "qi", "tau"), "thresholds")
    left = seen.join(tau, ["q", "qi"], "left").filter("tau is null or lower <= tau")
    pairs = left.join(_query_rows(qb), ["q", "qi"]).select("c", "ci", "query_id", "x")
    found = stage(_distances(pairs, cb, s.k), "distances")
    unstage(cb, qb, seen, tau)
    return _merge(found, s.k)
