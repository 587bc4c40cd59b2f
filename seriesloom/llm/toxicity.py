"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word between them of a whole text, with value 1.
Training is FTRL-proximal with per-coordinate rates and L1/L2 terms: each coordinate keeps a gradient sum z and a
squared gradient sum n. It runs on a bounded sample of labelled rows, in shards that train on executors at the same time,
one partition each. After a pass the states are averaged part by part, again on the executors, and reach the next pass's
learners ahead of their rows; neither states nor rows go through the driver. The L1 term leaves few nonzero weights, and
these alone are collected and broadcast for scoring: at most `buckets` of them, 12 bytes each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_key, shuffle_partitions, stage, text_slices, unstage
from .shingles import U64, mix, word_hashes, word_spans

_SALTS = (U64(0x51ED270B), U64(0x2545F491), U64(0x9E3779B1))


@dataclass(frozen=True)
class Settings:
    """bits: 2**bits buckets. alpha, beta, l1, l2: FTRL parameters. sample_rows: bound on the labelled rows used.
    shard_rows: rows of a parallel learner. passes: rounds over the sample. balance: weight of a positive row is
    min(balance, negatives / positives)."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    sample_rows: int = 20_000
    shard_rows: int = 5_000
    passes: int = 3
    balance: float = 2.0


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, adjacent pairs and pairs around one word of each text (repeats included), and row numbers."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, rows = [mix(h ^ _SALTS[0])], [row]
    for gap in (1, 2):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            out.append(mix(h[:-gap] * U64(3) + mix(h[gap:] ^ _SALTS[gap]))[same])
            rows.append(row[gap:][same])
    return (np.concatenate(out) >> U64(64 - bits)).astype(np.int64), np.concatenate(rows)


def ftrl_weights(z: np.ndarray, n: np.ndarray, free, s: Settings) -> np.ndarray:
    """The weights of states (z, n); free ones aren't held at zero by L1."""
    l1 = np.where(free, 0.0, s.l1)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


class Ftrl:
    """FTRL-proximal with a state (z, n) per coordinate; the last one is the bias, which L1 doesn't hold at zero."""

    def __init__(self, size: int, s: Settings):
        self.z, self.n, self.s = np.zeros(size), np.zeros(size), s

    def weights(self, i) -> np.ndarray:
        return ftrl_weights(self.z[i], self.n[i], i == len(self.z) - 1, self.s)

    def learn(self, i: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - y) * weight
        n = self.n[i]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha
        self.z[i] += g - sigma * w
        self.n[i] = n + g * g


def _bias(s: Settings) -> int:
    return 1 << s.bits


#: Parts in which a state travels, and its rows: z and n of one part's coordinates.
PARTS = 64
STATE = "shard int, part int, z binary, n binary"


class _Learner:
    """A state that is put together from its parts and then learns rows, batch by batch."""

    def __init__(self, s: Settings):
        self.m = Ftrl(_bias(s) + 1, s)

    def take(self, part: int, z: bytes, n: bytes) -> None:
        for state, raw in ((self.m.z, z), (self.m.n, n)):
            state[_part(part, len(state))] = np.frombuffer(raw, np.float32)

    def learn(self, data: np.ndarray, offsets: np.ndarray, labels: list[float], boost: float) -> None:
        s = self.m.s
        f, row = features(data, offsets, s.bits)
        order = np.argsort(row, kind="stable")
        f, at = f[order], np.searchsorted(row[order], np.arange(len(labels) + 1))
        for j, y in enumerate(labels):
            self.m.learn(np.append(np.unique(f[at[j] : at[j + 1]]), _bias(s)), y, boost if y > 0 else 1.0)

    def rows(self, shard: int) -> pa.RecordBatch:
        z, n = ([x[_part(p, len(x))].astype(np.float32).tobytes() for p in range(PARTS)] for x in (self.m.z, self.m.n))
        return pa.RecordBatch.from_arrays([pa.array([shard] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array(z, pa.binary()), pa.array(n, pa.binary())], names=["shard", "part", "z", "n"])


def _part(p: int, size: int) -> slice:
    step = -(-size // PARTS)
    return slice(min(p * step, size), min((p + 1) * step, size))


def _average(groups):
    """The mean of the shards' states, part by part."""
    for t in groups:
        mean = [np.mean([np.frombuffer(x, np.float32) for x in t.column(c).to_pylist()], axis=0, dtype=np.float64).astype(np.float32).tobytes() for c in ("z", "n")]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), t.column("part").combine_chunks().slice(0, 1), *(pa.array([x], pa.binary()) for x in mean)], names=["shard", "part", "z", "n"])


def fit(labelled: DataFrame, s: Settings | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the nonzero weights, from rows (doc_id, text, y); index 2**bits is the bias.

    At most about sample_rows rows are used, each chosen by a seeded draw of its own; rows with a null y are left out.
    Repeated rows count as often as they stand; texts of any length are learned whole. Without any labelled row the bias
    alone remains, and all scores are practically 0.
    """
    s = s or Settings()
    spark = labelled.sparkSession
    arrow_batches(spark)
    labelled = labelled.filter("y is not null")
    total, positive = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total:
        return np.array([_bias(s)]), np.array([-35.0])
    boost = min(s.balance, (total - positive) / positive) if positive else 1.0
    shards = max(1, min(total, s.sample_rows) // s.shard_rows)
    keep = F.lit(True) if total <= s.sample_rows else F.rand(17) < s.sample_rows / total
    none = F.lit(None).cast("binary")
    turn = (F.rand(29) * (1 << 30)).cast("int") + PARTS  # after the state's parts
    sample = labelled.filter(keep).select((F.rand(5) * shards).cast("int").alias("shard"), turn.alias("part"), none.alias("z"), none.alias("n"), "text", F.col("y").cast("double"))
    sample = stage(sample, "toxicity-sample")
    state = spark.createDataFrame([], STATE)

    def learn(batches):
        shard, learner = None, None
        for rows, data, offsets in text_slices(batches):
            shard_of, label = rows.column("shard").to_numpy(), rows.column("y").to_pylist()
            cut = [0, *(np.flatnonzero(shard_of[1:] != shard_of[:-1]) + 1).tolist(), len(shard_of)]
            for a, b in zip(cut, cut[1:]):
                if shard_of[a] != shard:
                    if learner is not None:
                        yield learner.rows(shard)
                    shard, learner = int(shard_of[a]), _Learner(s)
                while a < b and label[a] is None:
                    learner.take(*(rows.column(c)[a].as_py() for c in ("part", "z", "n")))
                    a += 1
                if a < b:
                    learner.learn(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], label[a:b], boost)
        if learner is not None:
            yield learner.rows(shard)

    for _ in range(s.passes):
        known = state.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "part", "z", "n", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("y"))
        dealt = known.unionByName(sample).repartitionById(shards, "shard").sortWithinPartitions("shard", "part")
        states = stage(dealt.mapInArrow(learn, STATE), "toxicity-states")
        new = stage(by_key(states, min(PARTS, shuffle_partitions(spark)), ["part"], _average, STATE), "toxicity-state")
        unstage(states, state)
        state = new

    def nonzero(batches):
        for batch in batches:
            for part, z, n in zip(*(batch.column(c).to_pylist() for c in ("part", "z", "n"))):
                at = np.arange(_bias(s) + 1)[_part(part, _bias(s) + 1)]
                w = ftrl_weights(np.frombuffer(z, np.float32).astype(np.float64), np.frombuffer(n, np.float32).astype(np.float64), at == _bias(s), s)
                few = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(at[few]), pa.array(w[few])], names=["i", "w"])

    got = state.mapInArrow(nonzero, "i long, w double").toArrow()
    unstage(sample, state)
    i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    order = np.argsort(i)
    return i[order], w[order]


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], s: Settings | None = None) -> DataFrame:
    """docs without text, with score double: the chance of label 1. Empty and null texts get the bias's score."""
    s = s or Settings()
    arrow_batches(docs.sparkSession)
    docs = docs.drop("score")
    keep = [c for c in docs.columns if c != "text"]
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = np.zeros(_bias(s) + 1)
        w[model.value[0]] = model.value[1]
        for rows, data, offsets in text_slices(batches):
            f, row = features(data, offsets, s.bits)
            hit = np.flatnonzero(w[f])
            pairs = np.unique(row[hit] << (s.bits + 1) | f[hit])
            total = w[_bias(s)] + np.bincount(pairs >> (s.bits + 1), w[pairs & ((1 << (s.bits + 1)) - 1)], rows.num_rows)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, docs.select(*keep, F.lit(0.0).alias("score")).schema)


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Rows with crc32(doc_id as text) mod 5 = 0 are held out; the others train, where labels (doc_id, toxic) has a label.
    Several labels of one doc_id count as their largest; null labels are left out. A row with a null doc_id is neither
    held out nor trained on. Other columns of either table, equal names included, are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out"))
    y = labels.select(F.col("doc_id").cast("long"), "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    weights = fit(rows.filter("not held_out").join(y, "doc_id").select("doc_id", "text", "y"), s)
    return score(rows, weights, s).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
