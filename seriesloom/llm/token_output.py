"""Token ids in binary shards: one zstandard frame per document, a shared dictionary and an offset index.

A data set is a folder with
    dictionary          the shared zstandard dictionary, trained on serialized id arrays (empty: none)
    shard-PPPPPPPP-KKKKKK    in ascending order of name the documents ascend by doc_id
A shard is  magic (8 bytes), dictionary hash (16), documents (u64), id bytes (u64), index place (u64), frames, index;
the index is  doc_id i64[n], tokens u64[n], frame place u64[n + 1]. All numbers are little-endian. Ids are stored in 2
bytes where the vocabulary allows it, else in 4. A single short document is read by one index read and one frame read.

Shards are written under a temporary name and moved into place, so a repeated task replaces its own shard by the same
bytes. Paths are those of a file system that all executors share, named by a URI.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordTable
from .common import arrow_batches, binary_rows, shuffle_partitions, stage, text_slices, unstage

MAGIC = b"SLTOKEN1"
HEAD = struct.Struct("<8s16sQQQ")
NO_ID = -(2**63)


@dataclass(frozen=True)
class Settings:
    """tokenizer: path of the tokenizer file. end_id: appended to every document. id_bytes: 2 or 4. sample_documents
    and sample_bytes bound what the dictionary is trained on. shard_bytes: a shard is closed once it holds as much."""

    tokenizer: str
    end_id: int | None = 2
    id_bytes: int = 2
    level: int = 3
    dictionary_bytes: int = 64 << 10
    sample_documents: int = 2000
    sample_bytes: int = 8 << 20
    shard_bytes: int = 32 << 20


def library_encoder(path: str) -> Callable:
    """Ids of a list of words by the tokenizers library: words are joined by spaces, which no token crosses, and each
    token goes to the word in which it starts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def encode(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for a in range(0, len(block), 2000):
            part = block[a : a + 2000]
            e = tok.encode(" ".join(part), add_special_tokens=False)
            start = np.zeros(len(part) + 1, np.int64)
            np.cumsum([len(w) + 1 for w in part], out=start[1:])
            owner = np.searchsorted(start, np.array([x[0] for x in e.offsets], np.int64), "right") - 1
            ids.append(np.array(e.ids, np.int32))
            counts.append(np.bincount(owner, minlength=len(part)))
        at = np.zeros(len(block) + 1, np.int64)
        np.cumsum(np.concatenate(counts), out=at[1:])
        return np.concatenate(ids), at

    return encode


_tables: dict[str, WordTable] = {}


def table_for(path: str) -> WordTable:
    """One word table per tokenizer and Python worker, kept over its tasks."""
    if path not in _tables:
        _tables[path] = WordTable(library_encoder(path))
    return _tables[path]


def _with_end(ids: np.ndarray, at: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end is None:
        return ids, at
    return np.insert(ids, at[1:], end), at + np.arange(len(at))


def _dtype(s: Settings):
    return np.dtype("<u2" if s.id_bytes == 2 else "<u4")


def train_dictionary(docs: DataFrame, s: Settings) -> bytes:
    """A zstandard dictionary from a bounded sample of rows, each chosen by a seeded draw of its own, so that neither rows
    without an id nor copies are taken together; encoding ends once sample_bytes are full. Too few or too uniform samples
    give none. It only affects sizes, never contents."""

    def run(batches):
        samples, size, table = [], 0, table_for(s.tokenizer)
        for rows, _, _ in text_slices(batches):
            if size >= s.sample_bytes:
                break
            ids, at = _with_end(*table.encode([t or "" for t in rows.column("text").to_pylist()]), s.end_id)
            for a, b in zip(at.tolist(), at[1:].tolist()):
                part = ids[a:b].astype(_dtype(s)).tobytes()[: s.sample_bytes - size]
                if part:
                    samples.append(part)
                    size += len(part)
        try:
            out = zstandard.train_dictionary(s.dictionary_bytes, samples).as_bytes() if len(samples) >= 20 else b""
        except zstandard.ZstdError:
            out = b""
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["dictionary"])

    n = docs.count()
    keep = F.lit(True) if n <= s.sample_documents else F.rand(41) < s.sample_documents / n
    got = docs.filter(keep).select("text").repartition(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(got[0][0]) if got else b""


def _hash(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=16).digest()


def encode_frames(docs: DataFrame, dictionary: bytes, s: Settings) -> DataFrame:
    """doc_id, n_tokens and the compressed frame of each document; null texts are empty."""

    def run(batches):
        table = table_for(s.tokenizer)
        packer = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for rows, _, _ in text_slices(batches):
            ids, at = _with_end(*table.encode([t or "" for t in rows.column("text").to_pylist()]), s.end_id)
            raw = memoryview(ids.astype(_dtype(s)).tobytes())
            cut = (at * s.id_bytes).tolist()
            frames = [packer.compress(raw[a:b]) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array(frames, pa.binary())], names=["doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, frame binary")


class _Shard:
    def __init__(self, folder: str, name: str, dictionary_hash: bytes, id_bytes: int):
        self.fs, at = fs.FileSystem.from_uri(folder)
        self.final, self.tmp = f"{at}/{name}", f"{at}/_tmp-{name}-{os.getpid()}-{os.urandom(4).hex()}"
        self.hash, self.id_bytes, self.name = dictionary_hash, id_bytes, name
        self.out = self.fs.open_output_stream(self.tmp)
        self.size = HEAD.size
        self.ids, self.tokens, self.place = [], [], [HEAD.size]
        self.body: list[bytes] = []

    def add(self, doc_id, tokens: int, frame: bytes) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.tokens.append(tokens)
        self.body.append(frame)
        self.size += len(frame)
        self.place.append(self.size)

    def close(self) -> tuple[str, int, int]:
        self.out.write(HEAD.pack(MAGIC, self.hash, len(self.ids), self.id_bytes, self.size))
        for x in self.body:
            self.out.write(x)
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.tokens, "<u8").tobytes() + np.array(self.place, "<u8").tobytes())
        self.out.close()
        try:
            self.fs.move(self.tmp, self.final)
        except OSError:  # some stores don't replace: another attempt at this task has put the same bytes there
            if self.fs.get_file_info(self.final).type != fs.FileType.File:
                raise
            self.fs.delete_file(self.tmp)
        return self.name, len(self.ids), sum(self.tokens)


def write_tokens(docs: DataFrame, folder: str, s: Settings) -> list[tuple[str, int, int]]:
    """Encodes docs (doc_id, text) and writes the data set; (shard, documents, tokens) in ascending order.

    Null texts are empty documents that hold the end id alone. Rows that repeat a doc_id stay next to each other, in
    ascending order of frame bytes. Rows without a doc_id come first and have no id. An empty table gives a dictionary
    file and no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(docs, s)
    where, at = fs.FileSystem.from_uri(folder)
    where.create_dir(at, recursive=True)
    with where.open_output_stream(f"{at}/dictionary") as out:
        out.write(dictionary)
    digest = _hash(dictionary)

    def run(batches):
        part, k, shard, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for i, n, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                if shard is None:
                    shard = _Shard(folder, f"shard-{part:08d}-{k:06d}", digest, s.id_bytes)
                shard.add(i, n, f)
                if shard.size >= s.shard_bytes:
                    done.append(shard.close())
                    shard, k = None, k + 1
        if shard is not None:
            done.append(shard.close())
        if done:
            names, docs_, tokens = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(docs_, pa.int64()), pa.array(tokens, pa.int64())], names=["shard", "documents", "tokens"])

    frames = stage(encode_frames(docs, dictionary, s), "frames")
    rows = frames.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "frame").mapInArrow(run, "shard string, documents long, tokens long").collect()
    unstage(frames)
    return sorted((r.shard, r.documents, r.tokens) for r in rows)


class ShardReader:
    """Reads a shard: its index at once, frames one by one."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        where, at = fs.FileSystem.from_uri(folder)
        if dictionary is None:
            with where.open_input_stream(f"{at}/dictionary") as f:
                dictionary = f.read()
        self.file = where.open_input_file(f"{at}/{name}")
        magic, digest, n, self.id_bytes, index = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC or digest != _hash(dictionary):
            raise ValueError(f"{name} isn't a shard written with this dictionary")
        raw = self.file.read_at(8 * (3 * n + 1), index)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.tokens = np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)
        self.place = np.frombuffer(raw, "<u8", n + 1, 16 * n).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the shard, as little-endian unsigned 32-bit integers."""
        a, b = int(self.place[i]), int(self.place[i + 1])
        raw = self.unpack.decompress(self.file.read_at(b - a, a), max_output_size=max(1, int(self.tokens[i]) * self.id_bytes))
        return np.frombuffer(raw, "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        i = int(np.searchsorted(self.doc_ids, doc_id))
        return self.ids(i) if i < len(self.doc_ids) and self.doc_ids[i] == doc_id else None

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i, d in enumerate(self.doc_ids.tolist()):
            yield (None if d == NO_ID else d), self.ids(i)


TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_tokens(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids (4 bytes each), read from the
    files; shards is what write_tokens returned, one entry per shard file."""
    first = np.concatenate([[0], np.cumsum([t for _, _, t in shards])]).tolist() if shards else []
    rows = [(name, start) for (name, _, _), start in zip(shards, first)]
    table = spark.createDataFrame(rows, "shard string, start long").repartition(max(1, len(rows)))

    def run(batches):
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "start"))):
                held, size = [], 0
                for doc_id, ids in ShardReader(folder, name):
                    raw = ids.tobytes()
                    held.append((doc_id, start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    start += len(ids)
                    size += len(raw)
                    if len(held) >= 2000 or size > 8 << 20:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    return table.mapInArrow(run, TOKENS)


def _rows(held) -> pa.RecordBatch:
    d, s, n, c, raw = zip(*held)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (d, s, n, c)), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
