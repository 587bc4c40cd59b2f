"""Removal of repeated passages by a distributed, length-bounded difference-cover algorithm.

Whether a byte goes depends on equal strings of `length` bytes alone, so suffixes need sorting by their first `length`
bytes only, and the recursion on names ends after one step:

1. Sample. Positions whose offset lies in a difference cover modulo v are sampled. For any two positions there is a
   shift under v that takes both to sampled ones, so two equal strings of `length` bytes hold equal sampled tuples of
   length - v + 1 bytes at equal places.
2. Sort sampled tuples. Each block of documents sorts its tuples by fingerprint; equal ones get one name. The sorted
   names meet name range by name range, where those that stand only once in the corpus are found and discarded.
3. Recurse on names. A string of `length` bytes can only repeat where some sampled tuple at most v - 1 bytes after its
   start has a repeated name. Only these positions, sampled or not, are named again, now by all their `length` bytes.
4. Merge. The new names meet range by range in sorted order; equal neighbours are equal strings, and the smallest
   document among them says for each block which of its strings start earlier elsewhere.
Whole documents that copy an earlier one are found by digest first and take no part in steps 3 and 4.

Step 2 only rules positions out, so its names may collide. Those of step 4 have 84 bits: n strings of different content
share one with a chance of about n * n / 2**85. Names travel as sorted differences of their first 64 bits with the other 20
beside them, never as rows, and one range holds at most about `range_names` of them. Answers are bit maps that each block
reads from the shared folder, where the blocks of several input partitions share a file.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_key, fresh_path, stage, unstage
from .shingles import EXACT, U64, mix, powers

#: A perfect difference set; every residue modulo 57 is a difference of two of its members.
CYCLE, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
LAST = 2**63 - 1
#: Parts into which the copies of one text are dealt when they are joined.
SALTS = 16
PACKED = "block long, n_docs long, n_names long, ids binary, offsets binary, data binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


@dataclass(frozen=True)
class Settings:
    """length: bytes of a string that counts as repeated; over 2 * 57. block_bytes: text handled at a time.
    range_names: names that meet in one place, on average. name_bits: of the sorted part of a name; fewer only serve to
    test that equal ones are told apart."""

    length: int = 100
    block_bytes: int = 6 << 20
    range_names: int = 2_000_000
    name_bits: int = 64

    @property
    def tuple_bytes(self) -> int:
        return self.length - CYCLE + 1


def pack_numbers(x: np.ndarray) -> bytes:
    """Compressed bytes of unsigned 64-bit numbers, one plane per byte place."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, 8 * n)), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack_numbers(np.diff(x, prepend=U64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_numbers(raw, n), dtype=U64)


class Prefix:
    """Polynomial prefix sums of a block, from which the hash of any string of it follows. Up to `STRETCH` bytes are
    summed once and kept; a longer block is summed stretch by stretch. values: the numbers that stand for the bytes."""

    STRETCH = 1 << 20

    def __init__(self, data: np.ndarray, values: np.ndarray = EXACT):
        self.data, self.values, self.kept = data, values, None

    def _sums(self, a: int, z: int) -> np.ndarray:
        part = self.data[a:z]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(self.values[part] * powers(len(part) + 1)[0][: len(part)], out=total[1:])
        return total

    def hashes(self, places: np.ndarray, length: int) -> np.ndarray:
        """A hash of the `length` bytes from each place (ascending)."""
        n = len(self.data)
        if n <= self.STRETCH:
            if self.kept is None:
                self.kept = self._sums(0, n)
            return mix((self.kept[places + length] - self.kept[places]) * powers(n + 1)[1][places])
        out = np.empty(len(places), U64)
        for a in range(0, n, self.STRETCH):
            lo, hi = np.searchsorted(places, (a, a + self.STRETCH))
            if lo < hi:
                total, p = self._sums(a, a + self.STRETCH + length), places[lo:hi] - a
                out[lo:hi] = mix((total[p + length] - total[p]) * powers(len(total))[1][p])
        return out


#: The second part of a name: the lower bits of a hash of its own.
TAG = U64((1 << 20) - 1)
_SECOND = np.random.Generator(np.random.PCG64(100)).integers(0, 2**64, 256, dtype=U64)


def sampled(offsets: np.ndarray, s: Settings) -> np.ndarray:
    """The sampled places of a block that have a whole tuple in their document, ascending."""
    lens = np.diff(offsets)
    out = []
    for c in COVER:
        n = np.maximum(0, (lens - s.tuple_bytes - c) // CYCLE + 1)
        n[lens < s.length] = 0
        first = np.cumsum(n) - n
        out.append(np.repeat(offsets[:-1] + c - first * CYCLE, n) + np.arange(n.sum()) * CYCLE)
    return np.sort(np.concatenate(out))


def ranges(names: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit numbers begins in the sorted names (n + 1 entries)."""
    edges = np.array([(i << 64) // n for i in range(1, n)], U64)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def pack_blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """Documents in blocks of about block_bytes, in order of doc_id inside a block; one row per block."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def out(number):
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            offsets = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(texts[i]) for i in order], out=offsets[1:])
            data = b"".join(texts[i] for i in order)
            n = len(sampled(offsets, s))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)]), pa.array([n]), pa.array([np.array(ids, "<i8")[order].tobytes()], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), pa.array([data], pa.binary())], names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(LAST if d is None else d)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= s.block_bytes:
                    yield out(number)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield out(number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, PACKED)


class BlockText:
    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c: batch.column(c)[i].as_py()
        self.number = get("block")
        self.ids, self.offsets = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("offsets"), np.int64)
        self.data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)

        self.prefix = Prefix(self.data)
        self.lens = np.diff(self.offsets)
        self.row_of = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lens)

    def names(self, s: Settings, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places and their names, cut by `drop` bits."""
        at = sampled(self.offsets, s)
        return at, self.prefix.hashes(at, s.tuple_bytes) >> drop << drop

    def strings(self, s: Settings, at: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that have one of the sampled places `at` less than a cycle after them, and the two parts of their names."""
        n = len(self.data)
        edge = np.bincount(np.maximum(at - CYCLE + 1, self.offsets[self.row_of[at]]), minlength=n + 1).astype(np.int32)
        edge[at + 1] -= 1
        ok = np.cumsum(edge[:n], dtype=np.int32) > 0
        none = (self.lens < s.length) | skip
        for d in np.flatnonzero(none):
            ok[self.offsets[d] : self.offsets[d + 1]] = False
        tail = self.offsets[1:][~none]
        if len(tail):
            ok[(tail[:, None] - np.arange(1, s.length)).ravel()] = False
        places = np.flatnonzero(ok)
        drop = U64(64 - s.name_bits)
        return places, self.prefix.hashes(places, s.length) >> drop << drop, Prefix(self.data, _SECOND).hashes(places, s.length) & TAG


def distinct_sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and whether each stands more than once."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x))) > 1


def runs(names: np.ndarray, tags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal names together, and where in it a new one begins. Tags tell names of equal halves apart;
    they are sorted only where some do."""
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], names[order][1:] != names[order][:-1]]) if len(names) else np.zeros(0, bool)
    if tags is not None and len(names):
        differ = tags[order][1:] != tags[order][:-1]
        if (differ & ~new[1:]).any():
            order = np.lexsort((tags, names))
            new[1:] = (names[order][1:] != names[order][:-1]) | (tags[order][1:] != tags[order][:-1])
    return order, new


def members(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted chosen ones: a small table on the upper bits rules most out, a search the rest."""
    if not len(chosen):
        return np.zeros(len(x), bool)
    bits = U64(64 - 24)
    table = np.zeros(1 << 24, bool)
    table[(chosen >> bits).astype(np.int64)] = True
    out = table[(x >> bits).astype(np.int64)]
    at = np.flatnonzero(out)
    i = np.minimum(np.searchsorted(chosen, x[at]), len(chosen) - 1)
    out[at] = chosen[i] == x[at]
    return out


#: Input partitions whose answers share a folder, as a power of two: blocks are numbered from partition << 32.
SHARED = 35


def _part_rows(folder: str, block: int, columns: list[str]) -> list[dict]:
    """The rows of a block in a table that _write_by_block has written; row groups without it are skipped."""
    where, at = fs.FileSystem.from_uri(folder)
    info = where.get_file_info(f"{at}/part={block >> SHARED}")
    out: list[dict] = []
    if info.type == fs.FileType.Directory:
        for f in where.get_file_info(fs.FileSelector(info.path)):
            if f.path.endswith(".parquet"):
                out += pq.read_table(f.path, filesystem=where, columns=columns, filters=[("block", "==", block)], partitioning=None).to_pylist()
    return out


def _write_by_block(df: DataFrame, n: int, name: str) -> str:
    """Writes rows (block, ...) in files that each hold the blocks of several input partitions, in order of block."""
    folder = fresh_path(df.sparkSession, name)
    part = F.shiftright("block", SHARED)
    df.withColumn("part", part).repartition(n, "part").sortWithinPartitions("part", "block").write.option("parquet.block.size", str(1 << 18)).partitionBy("part").parquet(folder)
    return folder


def _answers(folder: str, block: int) -> dict[int, bytes]:
    """The bit maps of a block by name range, from the shared folder."""
    return {r["range"]: r["bits"] for r in _part_rows(folder, block, ["range", "bits"])}


def _flags(answers: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    """One flag per sorted name from the bit maps of all ranges."""
    out = np.zeros(cuts[-1], bool)
    for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if b > a and r in answers:
            out[a:b] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=b - a)
    return out


MESSAGE = "range int, block long, n long, names binary, tags binary, first long, docs binary"
ANSWER = "block long, range int, bits binary"


def _messages(block: int, names: np.ndarray, n: int, tags: np.ndarray | None = None, docs: np.ndarray | None = None) -> pa.RecordBatch:
    cuts = ranges(names, n)
    rows = [(r, int(a), int(b)) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    first = [int(docs[a:b].min()) if docs is not None else 0 for _, a, b in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r for r, _, _ in rows], pa.int32()),
            pa.array([block] * len(rows), pa.int64()),
            pa.array([b - a for _, a, b in rows], pa.int64()),
            pa.array([pack_sorted(names[a:b]) for _, a, b in rows], pa.binary()),
            pa.array([b"" if tags is None else pack_numbers(tags[a:b]) for _, a, b in rows], pa.binary()),
            pa.array(first, pa.int64()),
            pa.array([b"" if docs is None else pack_numbers((docs[a:b] - f).astype(U64)) for (_, a, b), f in zip(rows, first)], pa.binary()),
        ],
        names=["range", "block", "n", "names", "tags", "first", "docs"],
    )


def _meet(groups, by_document: bool):
    """For each block of a range: which of its names stand in another block (or, by_document, in an earlier document)."""
    for t in groups:
        n = t.column("n").to_pylist()
        names = np.concatenate([unpack_sorted(raw, k) for raw, k in zip(t.column("names").to_pylist(), n)])
        tags = np.concatenate([unpack_numbers(raw, k) for raw, k in zip(t.column("tags").to_pylist(), n)]) if by_document else None
        order, new = runs(names, tags)
        group = np.empty(len(names), np.int64)
        group[order] = np.cumsum(new) - 1
        if by_document:
            docs = np.concatenate([unpack_numbers(raw, k).astype(np.int64) + f for raw, k, f in zip(t.column("docs").to_pylist(), n, t.column("first").to_pylist())])
            least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
            flag = docs > least[group]
        else:
            flag = np.bincount(group)[group] > 1
        cut = np.concatenate([[0], np.cumsum(n)])
        bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), t.column("range").combine_chunks(), pa.array(bits, pa.binary())], names=["block", "range", "bits"])


def repeated_passages(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_bytes, spans and kept for each row of docs (doc_id, text): the byte ranges that repeat earlier text, and
    the remaining bytes.

    A byte goes if a string of `length` bytes over it also starts in a document of smaller doc_id, or earlier in the same
    row. Overlapping occurrences count, and strings are judged on the input. A null text is empty. Rows that repeat a
    doc_id are no reason to remove anything from each other; rows without a doc_id count as later than all others.
    Texts shorter than `length` stay whole. Other columns are ignored; an empty table gives an empty result.
    """
    s = s or Settings()
    if s.length < 2 * CYCLE - 14:
        raise ValueError("length is too small for the difference cover")
    spark = docs.sparkSession
    arrow_batches(spark)
    packed = stage(pack_blocks(docs, s), "blocks", group_rows=1)  # a task may have any number of blocks, and holds one
    blocks, n_names = packed.agg(F.count("*"), F.coalesce(F.sum("n_names"), F.lit(0))).first()
    if not blocks:
        return spark.createDataFrame([], RESULT)
    spread = min(blocks, 4096)  # files of answers are written by so many tasks
    n = max(1, math.ceil(n_names / s.range_names))
    # names keep as many bits as let a name that stands once pass for repeated about once in ten thousand times
    drop = U64(max(0, 64 - (max(n_names, 1).bit_length() + 14)))

    def named(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = BlockText(batch, i)
                h, _ = distinct_sorted(b.names(s, drop)[1])
                if len(h):
                    yield _messages(b.number, h, n)

    answers = _write_by_block(by_key(packed.mapInArrow(named, MESSAGE), n, ["range"], lambda g: _meet(g, False), ANSWER), spread, "repeated-names")

    def digests(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = BlockText(batch, i)
                raw, cut = b.data.tobytes(), b.offsets.tolist()
                keys = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([b.number] * len(keys), pa.int64()), pa.array(range(len(keys)), pa.int64()), pa.array(b.ids), pa.array(keys, pa.binary())], names=["block", "row", "doc_id", "digest"])

    whole = stage(packed.mapInArrow(digests, "block long, row long, doc_id long, digest binary"), "digests")
    firsts = whole.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    # written with all its parts, so that few are broadcast; if they are many, the copies of one text are dealt into parts
    firsts = stage(firsts, "first-copies")
    salted = stage(firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "salted-copies")
    copies = whole.withColumn("salt", F.pmod(F.xxhash64("block", "row"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).filter("doc_id > least").select("block", "row")
    copied = _write_by_block(copies, spread, "copies")
    unstage(whole, firsts, salted)

    def prepared(b: BlockText):
        skip = np.zeros(len(b.ids), bool)
        skip[[r["row"] for r in _part_rows(copied, b.number, ["row"])]] = True
        at, names = b.names(s, drop)
        short, more = distinct_sorted(names)
        flags = _flags(_answers(answers, b.number), ranges(short, n)) if len(short) else more
        return skip, at[members(names, short[flags | more])]

    def counted(b: BlockText):
        """Rows to skip, candidate places in order of their strings, the strings' names and where each begins."""
        skip, at = prepared(b)
        places, h, tag = b.strings(s, at, skip)
        order, new = runs(h, tag)
        new = np.flatnonzero(new)
        return skip, places[order], h[order][new], tag[order][new], new

    size = max(1, math.ceil(n_names * CYCLE / len(COVER) / 4 / s.range_names))  # about a quarter of all strings is named again

    def merged(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = BlockText(batch, i)
                _, places, names, tags, new = counted(b)
                if len(new):
                    yield _messages(b.number, names, size, tags, b.ids[b.row_of[np.minimum.reduceat(places, new)]])

    earlier = _write_by_block(by_key(packed.mapInArrow(merged, MESSAGE), size, ["range"], lambda g: _meet(g, True), ANSWER), spread, "earlier-strings")

    def result(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = BlockText(batch, i)
                skip, places, names, _, new = counted(b)
                gone = np.zeros(len(b.data) + 1, np.int32)
                if len(new):
                    flags = _flags(_answers(earlier, b.number), ranges(names, size))
                    n_each = np.diff(np.append(new, len(places)))
                    first = np.repeat(np.minimum.reduceat(places, new), n_each)  # rows ascend by doc_id in a block
                    row, first_row = b.row_of[places], b.row_of[first]
                    hit = np.repeat(flags, n_each) | (b.ids[row] > b.ids[first_row]) | ((row == first_row) & (places > first))
                    tied = ~hit & (row != first_row)
                    if tied.any():  # rows that repeat a doc_id: only a start before it in the same row counts
                        group = np.repeat(np.arange(len(new)), n_each)[tied]
                        order = np.lexsort((places[tied], row[tied], group))
                        again = np.zeros(len(order), bool)
                        g, r = group[order], row[tied][order]
                        again[order[1:]] = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
                        hit[np.flatnonzero(tied)[again]] = True
                    hit = places[hit]
                    gone[hit] += 1
                    gone[hit + s.length] -= 1
                removed = np.cumsum(gone[:-1]) > 0
                for d in np.flatnonzero(skip & (b.lens >= s.length)):
                    removed[b.offsets[d] : b.offsets[d + 1]] = True
                yield from _rows(b, removed)

    return packed.mapInArrow(result, RESULT)


def _rows(b: BlockText, removed: np.ndarray):
    cut = np.zeros(len(removed) + 1, bool)
    cut[b.offsets] = True
    start = np.flatnonzero(removed & (cut[:-1] | np.concatenate([[True], ~removed[:-1]])))
    stop = np.flatnonzero(removed & (cut[1:] | np.concatenate([~removed[1:], [True]]))) + 1
    first = np.searchsorted(start, b.offsets)
    kept_at = np.concatenate([[0], np.cumsum(~removed)])[b.offsets]
    kept = b.data[~removed].tobytes()
    n = len(b.ids)
    for a in range(0, n, 1000):
        z = min(n, a + 1000)
        lo, hi = first[a], first[z]
        doc = np.searchsorted(b.offsets, start[lo:hi], "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(start[lo:hi] - b.offsets[doc]), pa.array(stop[lo:hi] - b.offsets[doc])], ["start", "stop"])
        ids = pa.array([None if d == LAST else d for d in b.ids[a:z].tolist()], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array((first[a : z + 1] - lo).astype(np.int32)), spans)
        bytes_ = pa.array([kept[x:y] for x, y in zip(kept_at[a:z].tolist(), kept_at[a + 1 : z + 1].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(b.offsets)[a:z]), lists, bytes_], names=["doc_id", "n_bytes", "spans", "kept"])
