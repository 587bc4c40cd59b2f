"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Benchmark items are partitioned by the size of their shingle set. A document is cut, for each partition, into windows of
twice the partition's largest size that overlap by half, so an item that stands in the document lies whole in one
window, and window and item have a similarity bounded below by the partition. From that bound each partition gets its
number of bands (single minimum values), so that a contained item is retrieved with the chance `recall` at least.
Retrieved (document, item) pairs are verified on the whole sets: the share of the item's shingles in the document.

Items are dealt into groups of about `group_bytes`, whose indexes are built on the executors. One index at a time is
collected and broadcast, and released again once its pass over the documents is written; a larger benchmark takes more
passes, never a larger broadcast.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_key, byte_view, no_rows, shuffle_partitions, stage, text_slices, unstage, unused
from .shingles import MinHash, distinct, shingle_hashes

MATCHES = "doc_id long, item_id long, n_item long, n_common long, containment double"


@dataclass(frozen=True)
class Settings:
    """percent: share of an item's shingles that a document has to hold. growth: ratio of the largest to the smallest
    item size of a partition. recall: chance to retrieve a contained item. group_bytes: bytes of the items of a group, on
    average."""

    percent: int = 80
    growth: int = 2
    recall: float = 1 - 1e-5
    group_bytes: int = 16 << 20


class Index:
    """The items of one group: their shingle sets and, for each size partition, sorted minimum values per band."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, at: np.ndarray, s: Settings):
        self.ids, self.h, self.at, self.s = np.asarray(ids, np.int64), h, at, s
        sizes = np.diff(at)
        self.parts = []
        low = 1
        while len(sizes) and low <= sizes.max():
            high = low * s.growth - 1 if low > 1 else 1
            mine = np.flatnonzero((sizes >= low) & (sizes <= high))
            if len(mine):
                self.parts.append(self._part(mine, low, high))
            low = high + 1
        self.family = MinHash(max((p["bands"] for p in self.parts), default=1))
        for p in self.parts:
            sub, sub_at = self._subset(p["items"])
            sig = self.family.signatures(sub, sub_at)
            p["values"], p["owner"] = [], []
            for b in range(p["bands"]):
                order = np.argsort(sig[:, b], kind="stable")
                p["values"].append(sig[order, b])
                p["owner"].append(p["items"][order])

    def _part(self, mine, low, high):
        half = max(1, high)
        window, inside = 2 * half, math.ceil(low * self.s.percent / 100)
        j = inside / (window + low - inside)
        return {"items": mine, "half": half, "bands": math.ceil(math.log(1 - self.s.recall) / math.log(1 - j))}

    def _subset(self, items):
        sets = [self.h[self.at[i] : self.at[i + 1]] for i in items.tolist()]
        at = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(x) for x in sets], out=at[1:])
        return np.concatenate(sets), at

    def retrieve(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(document, item) rows that some window and some band bring together."""
        found = []
        lens = np.diff(at)
        for p in self.parts:
            half = p["half"]
            blocks = -(-lens // half)
            first = np.zeros(len(lens) + 1, np.int64)
            np.cumsum(blocks, out=first[1:])
            if not first[-1]:
                continue
            doc = np.repeat(np.arange(len(lens)), blocks)
            start = at[doc] + (np.arange(first[-1]) - first[doc]) * half
            last = np.zeros(first[-1], bool)
            last[first[1:][blocks > 0] - 1] = True
            for b in range(p["bands"]):
                low = np.minimum.reduceat(self.family.values(h, b), start)
                low[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                values = p["values"][b]
                lo = np.searchsorted(values, low, "left")
                hit = np.flatnonzero((lo < len(values)) & (values[np.minimum(lo, len(values) - 1)] == low))
                if len(hit):
                    lo = lo[hit]
                    n = np.searchsorted(values, low[hit], "right") - lo
                    owner = p["owner"][b][np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    found.append(np.unique(np.repeat(doc[hit], n) * len(self.ids) + owner))
        if not found:
            return np.zeros((0, 2), np.int64)
        pairs = np.unique(np.concatenate(found))
        return np.column_stack([pairs // len(self.ids), pairs % len(self.ids)])

    def matches(self, h: np.ndarray, at: np.ndarray):
        """(document, item, size, common) for pairs whose exact containment reaches the threshold."""
        out, d, own = [], -1, None
        for doc, item in self.retrieve(h, at).tolist():
            if doc != d:
                d, own = doc, np.unique(h[at[doc] : at[doc + 1]])
            mine = self.h[self.at[item] : self.at[item + 1]]
            i = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            common = int((own[i] == mine).sum())
            if 100 * common >= self.s.percent * len(mine):
                out.append((doc, item, len(mine), common))
        return out


def indexes(benchmark: DataFrame, s: Settings) -> DataFrame:
    """group, index: the packed index of each group of items, staged."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(4 * size / s.group_bytes))  # an index takes about four times its items' bytes
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int"))

    def build(tables):
        for t in tables:
            h, at = distinct(*shingle_hashes(*byte_view(t.column("text"))))
            keep = np.diff(at) > 0
            index = Index(t.column("item_id").to_numpy()[keep], h, np.concatenate([at[:-1][keep], at[-1:]]), s)
            yield pa.RecordBatch.from_arrays([t.column("group").combine_chunks().slice(0, 1), pa.array([pickle.dumps(index)], pa.large_binary()).cast(pa.binary())], names=["group", "index"])

    n = min(groups, shuffle_partitions(benchmark.sparkSession))
    return stage(by_key(dealt, n, ["group"], build, "group int, index binary"), "benchmark-indexes")


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment for each document that holds an item's shingles to `percent`.

    An item of one to four words has its whole sequence as its only shingle, and so matches documents that consist of
    just these words. Null or empty texts and items, and items without an id, match nothing. A document row with a null
    doc_id is matched too and keeps the null. Repeated item rows give their match once for each row; repeated documents
    are matched row by row. Other columns are ignored.
    """
    s = s or Settings()
    spark = docs.sparkSession
    arrow_batches(spark)
    out = no_rows(spark, MATCHES)
    built = indexes(benchmark, s)
    groups = sorted(r[0] for r in built.select("group").collect())
    for group in groups:
        index = spark.sparkContext.broadcast(pickle.loads(built.filter(F.col("group") == group).first()["index"]))

        def run(batches, index=index):
            for rows, data, offsets in text_slices(batches):
                found = index.value.matches(*shingle_hashes(data, offsets))
                if found:
                    d, i, n, c = (np.array(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()).take(pa.array(d)), pa.array(index.value.ids[i]), pa.array(n), pa.array(c), pa.array(c / n)], names=["doc_id", "item_id", "n_item", "n_common", "containment"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)
        if len(groups) > 1:
            found = stage(found, "matches")
            index.unpersist()
        out = out.unionByName(found)
    unstage(built)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of docs whose doc_id has no match; rows with a null doc_id stay."""
    name = unused("contaminated_id", docs)
    gone = stage(contaminated(docs, benchmark, s).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
