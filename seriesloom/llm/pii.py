"""Personal data: exact base patterns, and bootstrapped contextual extraction of identifiers they miss.

Base spans (email, ip, card, phone) are the seeds. A mention induces lexical patterns: the two words before it, and the
words on both sides. Patterns and values form a bipartite graph that grows round by round. Patterns that enough distinct
confident values of a kind support are usable; every other token or short sequence of digit groups that stands in one is an
unknown value, and every other context of a confident value is a new pattern. Spark scores the graph: a pattern's confidence
for a kind is the mean confidence of its distinct values, a value's is one minus the chance that all its patterns err, where
only usable patterns that are more likely right than wrong speak for it. Values that become confident support patterns of
their own in the next round, until nothing is new. How many distinct values stand in a pattern is estimated first, by
registers in a table of bounded size; patterns whose confident values are clearly outnumbered by it wait and bring in no
edges, so the graph grows with what is found and not with common words. No estimate rules a pattern out: once the others are
scored, all its values that had any confidence at any scoring of the round, or before it, and a sample of the rest are
gathered. The mean of their highest confidences is no less than that over all its values at any scoring, so below LIKELY the
pattern never spoke; each other one brings in all its edges, and the round is scored again. Once none is let in, every scoring
is that of all edges. Values that high-confidence patterns reach become spans of the kind wherever these patterns surround
them. Values count once however often they are copied.

Words are the runs between ASCII white space; in patterns A-Z are lower case and a run of digits counts as one 0. Words of
any length are taken whole. Patterns and values are known by 64-bit hashes, which are computed for a block of texts at once;
the graph holds no text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FINE_BYTES, arrow_batches, bit_filter, by_key, byte_view, flagged, no_rows, shuffle_partitions, stage, text_slices, unstage, unused
from .shingles import EXACT, U64, mix, word_hashes, word_spans

#: The kinds in their order and the characters of their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[0-9]+")
#: Punctuation that a value sheds at its start and end, and what a group of digits is made of.
_OPEN, _CLOSE, _GROUP = (np.isin(np.arange(256), list(x)) for x in (b"\"'([{<", b"\"'.,;:!?)]}>", b"0123456789+()./-"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
#: Most digit groups of a value, bits of the filters, and the confidence from which a pattern speaks for its values.
GROUPS, BITS, LIKELY = 8, 1 << 24, 0.5
#: Registers of an estimate, most estimates of the table and slots of one part of it, and the share of the estimated values
#: of a pattern that its confident ones must be for its edges to be gathered at once; other patterns wait until they are
#: proven not to speak, or let in.
REGISTERS, SLOTS, PART, SHARE = 64, 1 << 18, 1 << 12, 0.25
#: Parts into which the edges of a pattern or a value are dealt when they are joined.
SALTS = 16


@dataclass(frozen=True)
class Settings:
    """seeds: distinct confident values of a kind that a pattern needs. pattern: least confidence of a pattern that
    discovers. value: from which confidence a value counts as found. rounds: most rounds of growth, each of which reads the
    texts three times or more. scorings: scorings of the graph in a round."""

    seeds: int = 3
    pattern: float = 0.8
    value: float = 0.9
    rounds: int = 6
    scorings: int = 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    """Four dotted numbers, taken from each maximal dotted chain from left to right."""
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in code points, by start, then kind. Linear in the text."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = "".join(_NUMBER.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


class Words:
    """The words of a block of texts and the hashes of the patterns around them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        digit = _DIGIT[data]
        keep = np.ones(len(data), bool)
        keep[1:] = ~(digit[1:] & digit[:-1])
        at = np.concatenate([[0], np.cumsum(keep)])
        self.hash = word_hashes(np.where(digit, np.uint8(48), data)[keep], at[self.starts], at[self.ends])

    def patterns(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pattern before the words i..j and the one around them, 0 where the text has too few words for it."""
        low, high, h = self.first[self.row[i]], self.first[self.row[i] + 1], self.hash
        two = mix(mix(h[i - 2] + U64(1)) + h[i - 1] * U64(3)) | U64(1)
        around = mix(mix(h[i - 1] + U64(2)) + h[np.minimum(j + 1, len(h) - 1)] * U64(5)) | U64(1)
        return np.where(i - 2 >= low, two, U64(0)), np.where((i - 1 >= low) & (j + 1 < high), around, U64(0))

    def values(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return word_hashes(self.data, start, stop, EXACT)

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, byte start, byte stop) of every token, and of every sequence of up to GROUPS words that
        are groups of digits."""
        data, starts, ends = self.data, self.starts, self.ends
        a, b = starts.copy(), ends.copy()
        at = np.arange(len(a))
        while len(at := at[_OPEN[data[a[at]]]]):
            a[at] += 1
            at = at[a[at] < ends[at]]
        at = np.flatnonzero(b > a)
        while len(at := at[_CLOSE[data[b[at] - 1]]]):
            b[at] -= 1
            at = at[b[at] > a[at]]
        every = np.flatnonzero(b > a)
        out = [(every, every, a[every], b[every])]
        odd, digits = (np.concatenate([[0], np.cumsum(x)]) for x in (~_GROUP[data], _DIGIT[data]))
        group = (odd[b] == odd[starts]) & (digits[np.maximum(b, starts)] > digits[starts])
        whole = group & (odd[ends] == odd[starts])
        i = np.flatnonzero(whole[:-1]) if len(whole) else every
        for step in range(1, GROUPS):
            j = i + step
            i = i[(j < len(starts))]
            i = i[self.row[i] == self.row[i + step]]
            last = i[group[i + step]]
            out.append((last, last + step, starts[last], b[last + step]))
            i = i[whole[i + step]]
        return tuple(np.concatenate(x) for x in zip(*out))


def _clear(spans: list[tuple[int, int]], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which ranges overlap none of the spans."""
    if not spans:
        return np.ones(len(start), bool)
    a, b = (np.array(x) for x in zip(*spans))
    b = np.maximum.accumulate(b)
    k = np.searchsorted(a, stop, "left")
    return (k == 0) | (b[np.maximum(k - 1, 0)] <= start)


def mentions(words: Words, row: int, text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, stop, kind, value, patterns) of a text's base spans."""
    a, b = _in_bytes(words, row, text, spans)
    i = np.searchsorted(words.starts, a, "right") - 1
    j = np.searchsorted(words.starts, b - 1, "right") - 1
    before, around = (x.view(np.int64).tolist() for x in words.patterns(i, j))
    value = words.values(a, b).view(np.int64).tolist()
    return [(x, y, k, v, [p for p in (m, n) if p]) for (x, k, y), v, m, n in zip(spans, value, before, around)]


def _in_bytes(words: Words, row: int, text: str, spans) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of spans in code points as places in the block."""
    a, b = np.array([x for x, _, _ in spans]), np.array([y for _, _, y in spans])
    at = int(words.offsets[row])
    if not text.isascii():
        raw = words.data[at : words.offsets[row + 1]]
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        heads = np.append(heads, len(raw))
        a, b = heads[a], heads[b]
    return a + at, b + at


class Filter:
    """The hashes whose lower part a bit filter knows."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        return flagged(self.words, (hashes & U64(BITS - 1)).astype(np.int64)) & (hashes != U64(0))


def _found(words: Words, rows: pa.RecordBatch, chosen: np.ndarray, slots) -> tuple[np.ndarray, ...]:
    """The chosen slots that overlap no base span."""
    clear = _unspoken(words, rows, chosen, slots)
    return tuple(x[clear] for x in slots)


def _unspoken(words: Words, rows: pa.RecordBatch, chosen: np.ndarray, slots) -> np.ndarray:
    """The numbers of the chosen slots that overlap no base span."""
    i, j, start, stop = (x[chosen] for x in slots)
    row = words.row[i]
    clear = np.ones(len(i), bool)
    for r in np.unique(row).tolist():
        text = rows.column("text")[r].as_py()
        spans = base_spans(text)
        if spans:
            mine = np.flatnonzero(row == r)
            a, b = _in_bytes(words, r, text, spans)
            clear[mine] = _clear(sorted(zip(a.tolist(), b.tolist())), start[mine], stop[mine])
    return chosen[clear]


def edges_of(docs: DataFrame, patterns: DataFrame, values: DataFrame | None) -> DataFrame:
    """(pattern, value): what stands in the slots of `patterns` (pattern), and the patterns around `values` (value), with a
    few others that the filters let through; repeats are dropped block by block."""
    sought = np.zeros(BITS // 64, np.int64) if values is None else bit_filter(values, "value", BITS)
    shared = docs.sparkSession.sparkContext.broadcast((bit_filter(patterns, "pattern", BITS), sought))

    def run(batches):
        known, wanted = (Filter(x) for x in shared.value)
        for rows, data, offsets in text_slices(batches, size=FINE_BYTES):
            w = Words(data, offsets)
            if not len(w.starts):
                continue
            slots = w.slots()
            two, around = w.patterns(slots[0], slots[1])
            chosen = np.flatnonzero(known[two] | known[around] | wanted[w.values(slots[2], slots[3])])
            if not len(chosen):
                continue
            i, j, start, stop = _found(w, rows, chosen, slots)
            value = w.values(start, stop)
            sure, out = wanted[value], []
            for p in w.patterns(i, j):
                take = (p != U64(0)) & (known[p] | sure)
                out.append(np.column_stack([p[take], value[take]]))
            out = np.unique(np.concatenate(out), axis=0).view(np.int64)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, c])) for c in (0, 1)], names=["pattern", "value"])

    return _keyed(docs).mapInArrow(run, "pattern long, value long")


def _sampled(value: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Which values belong to a sample of one in 2**shift."""
    return mix(value ^ U64(0x3C3C3C3C3C3C3C3C)) & ((U64(1) << shift.astype(U64)) - U64(1)) == 0


def evidence_of(docs: DataFrame, waiting: DataFrame, values: DataFrame, slots: int) -> DataFrame:
    """(pattern, value): what stands in the slots of `waiting` (pattern, n, values): all of `values` (value) that do, and a
    sample of the others, of some 32 for each confident one; with a few others that the filters let through."""
    rate = F.floor(F.log2(F.greatest(F.col("values") / (32 * F.col("n") + 256), F.lit(1.0)))).cast("long")
    found = waiting.select(_slot(F.col("pattern"), slots).alias("slot"), rate.alias("rate")).groupBy("slot").agg(F.min("rate").alias("rate")).toArrow()
    rates = np.zeros(slots, np.uint8)
    rates[found.column("slot").to_numpy()] = found.column("rate").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((bit_filter(waiting, "pattern", BITS), bit_filter(values, "value", BITS), rates))

    def run(batches):
        known, wanted, rates = (*(Filter(x) for x in shared.value[:2]), shared.value[2])
        for rows, data, offsets in text_slices(batches, size=FINE_BYTES):
            w = Words(data, offsets)
            if not len(w.starts):
                continue
            every = w.slots()
            two, around = w.patterns(every[0], every[1])
            at = np.flatnonzero(known[two] | known[around])
            if not len(at):
                continue
            slots_ = tuple(x[at] for x in every)
            value, sides = w.values(slots_[2], slots_[3]), (two[at], around[at])
            sure = wanted[value]
            takes = [known[p] & (sure | _sampled(value, rates[((p >> U64(24)) & U64(slots - 1)).astype(np.int64)])) for p in sides]
            chosen = np.flatnonzero(takes[0] | takes[1])
            if not len(chosen):
                continue
            clear = _unspoken(w, rows, chosen, slots_)
            out = [np.column_stack([p[clear][t[clear]], value[clear][t[clear]]]) for p, t in zip(sides, takes)]
            out = np.unique(np.concatenate(out), axis=0).view(np.int64)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, c])) for c in (0, 1)], names=["pattern", "value"])

    return _keyed(docs).mapInArrow(run, "pattern long, value long")


def _registers(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The register of each value and the length of its run of zeros, from one."""
    h = mix(value ^ U64(0xA5A5A5A5A5A5A5A5))
    rest = (h >> U64(6)) | (U64(1) << U64(57))
    lowest = rest & (~rest + U64(1))
    return (h & U64(REGISTERS - 1)).astype(np.int64), (np.log2(lowest.astype(np.float64)) + 1).astype(np.uint8)


def _estimates(registers: np.ndarray) -> np.ndarray:
    """Distinct values by the registers of each slot (Flajolet et al. 2007, with linear counting for small numbers)."""
    zeros = (registers == 0).sum(1)
    raw = 0.709 * REGISTERS**2 / np.exp2(-registers.astype(np.float64)).sum(1)
    return np.where((raw <= 2.5 * REGISTERS) & (zeros > 0), REGISTERS * np.log(REGISTERS / np.maximum(zeros, 1)), raw)


def _slot(pattern, slots: int):
    return F.shiftrightunsigned(pattern, 24).bitwiseAND(F.lit(slots - 1))


def distinct_values(docs: DataFrame, patterns: DataFrame, slots: int) -> DataFrame:
    """slot, values: about how many distinct values stand in the patterns that fall on each slot. Every task fills a table
    of its own; tables are merged part by part, and repeated values change nothing."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bit_filter(patterns, "pattern", BITS))

    def run(batches):
        known, table = Filter(shared.value), np.zeros((slots, REGISTERS), np.uint8)
        for _, data, offsets in text_slices(batches, size=FINE_BYTES):
            w = Words(data, offsets)
            if not len(w.starts):
                continue
            i, j, start, stop = w.slots()
            for p in w.patterns(i, j):
                hit = np.flatnonzero(known[p])
                if len(hit):
                    register, zeros = _registers(w.values(start[hit], stop[hit]))
                    np.maximum.at(table, (((p[hit] >> U64(24)) & U64(slots - 1)).astype(np.int64), register), zeros)
        for a in range(0, slots, PART):
            if (part := table[a : a + PART]).any():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], names=["first", "registers"])

    def merge(groups):
        for t in groups:
            total = None
            for raw in t.column("registers"):
                one = np.frombuffer(zstandard.decompress(raw.as_py()), np.uint8)
                total = one if total is None else np.maximum(total, one)
            total = total.reshape(-1, REGISTERS)
            used = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used + t.column("first")[0].as_py()), pa.array(_estimates(total[used]))], names=["slot", "values"])

    tables = _keyed(docs).mapInArrow(run, "first long, registers binary")
    n = min(max(1, slots // PART), shuffle_partitions(spark))
    return stage(by_key(tables, n, ["first"], merge, "slot long, values double"), "distinct-values")


def places_of(docs: DataFrame, patterns: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, text_key, start, stop (code points), pattern, value: where values stand in slots of patterns, with a few
    others that the filters let through."""
    shared = docs.sparkSession.sparkContext.broadcast((bit_filter(patterns, "pattern", BITS), bit_filter(values, "value", BITS)))

    def run(batches):
        known, wanted = (Filter(x) for x in shared.value)
        for rows, data, offsets in text_slices(batches, size=FINE_BYTES):
            w = Words(data, offsets)
            if not len(w.starts):
                continue
            slots = w.slots()
            two, around = w.patterns(slots[0], slots[1])
            chosen = np.flatnonzero((known[two] | known[around]) & wanted[w.values(slots[2], slots[3])])
            if not len(chosen):
                continue
            i, j, start, stop = _found(w, rows, chosen, slots)
            head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte
            row, value = w.row[i], w.values(start, stop).view(np.int64)
            base = head[offsets[row]]
            for p in w.patterns(i, j):
                take = np.flatnonzero(known[p])
                if len(take):
                    at = pa.array(row[take])
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(at), rows.column("text_key").take(at), pa.array((head[start] - base)[take]), pa.array((head[stop] - base)[take]), pa.array(p.view(np.int64)[take]), pa.array(value[take])], names=["doc_id", "text_key", "start", "stop", "pattern", "value"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, start long, stop long, pattern long, value long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


_MENTION = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_SCAN = "row long, doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, mentions array<struct<start:long,stop:long,kind:int,value:long,patterns:array<long>>>"


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: base counts, the digest of the base spans, and all mentions."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for rows, _, _ in text_slices(batches):
            n = rows.num_rows
            texts = [t or "" for t in rows.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            counts = [[sum(s[1] == k for s in mine) for mine in spans] for k in range(4)]
            digests = [hashlib.sha256(spell(mine).encode()).hexdigest() for mine in spans]
            found: list[list] = [[] for _ in range(n)]
            some = [r for r, mine in enumerate(spans) if mine]
            if some:
                words = Words(*byte_view(rows.column("text").take(pa.array(some))))
                for i, r in enumerate(some):
                    found[r] = [dict(zip(("start", "stop", "kind", "value", "patterns"), m)) for m in mentions(words, i, texts[r], spans[r])]
            ids = pa.array(range(row, row + n), pa.int64())
            row += n
            yield pa.RecordBatch.from_arrays([ids, rows.column("doc_id").cast(pa.int64()), rows.column("text_key"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(found, pa.list_(_MENTION))], names=["row", "doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "mentions"])

    return _keyed(docs).mapInArrow(run, _SCAN)


_KS = range(len(KINDS))
_NO_SPANS = "array<struct<start:long,kind:int,stop:long>>"


def _join(edges: DataFrame, scores: DataFrame, by: str, other: str, how: str = "inner") -> DataFrame:
    """edges with the scores of their `by` end. The edges of one end are dealt into SALTS parts, so that a common pattern or
    value isn't one task's."""
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted, [by, "salt"], how).drop("salt")


def _usable(counts: DataFrame, s: Settings) -> DataFrame:
    """pattern, n: those with enough confident values (n0..) of one kind."""
    most = F.greatest(*(F.col(f"n{k}") for k in _KS))
    return counts.select("pattern", most.alias("n")).filter(F.col("n") >= s.seeds)


def _slots(count: int) -> int:
    return min(max(PART, 1 << (8 * count).bit_length()), SLOTS)


def _divided(docs: DataFrame, usable: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(pattern, n, values) of the usable patterns whose confident values aren't clearly outnumbered, and of those that wait,
    staged; values: the estimated number of values."""
    there = distinct_values(docs, usable, _slots(count))
    estimated = stage(usable.withColumn("slot", _slot(F.col("pattern"), _slots(count))).join(there, "slot", "left").select("pattern", "n", F.coalesce("values", F.lit(0.0)).alias("values")), "estimated")
    enough = F.col("n") >= SHARE * F.col("values")
    out = tuple(stage(estimated.filter(x), "patterns") for x in (enough, ~enough))
    unstage(there, estimated)
    return out


def _not_outnumbered(docs: DataFrame, usable: DataFrame, count: int) -> DataFrame:
    """The usable patterns whose edges are gathered at once, staged; _grown sees to the others."""
    chosen, waiting = _divided(docs, usable, count)
    unstage(waiting)
    return chosen.select("pattern")


class _Graph:
    """Scores of the patterns and values of one round; before: the values' confidence in the round before. waiting: patterns
    whose edges aren't all here, which have no confidence; highest: the highest confidence of each value at any scoring or
    before, where patterns wait."""

    def __init__(self, edges: DataFrame, before: DataFrame | None, s: Settings, waiting: DataFrame | None = None):
        self.s, self.values, self.waiting, self.highest = s, before, waiting, None
        scored = []
        for _ in range(s.scorings):
            self.patterns = self._patterns(edges)
            self.values = self._values(edges)
            if waiting is not None:
                self.values = stage(self.values, "value-scores")
                scored.append(self.values)
        if waiting is None:
            self.values = stage(self.values, "value-scores")
            scored.append(self.values)
        else:
            ever = reduce(DataFrame.unionByName, scored if before is None else [before, *scored])
            self.highest = stage(ever.groupBy("value").agg(*(F.max(f"v{k}").alias(f"v{k}") for k in _KS)), "highest-scores")
        self.patterns = stage(self._patterns(edges), "pattern-scores")
        self.staged = [self.patterns, *scored] + ([] if self.highest is None else [self.highest])

    def _patterns(self, edges: DataFrame) -> DataFrame:
        scores = self._means(edges, self.values)
        if self.waiting is None:
            return scores
        ps = [f"p{k}" for k in _KS]
        marked = scores.join(self.waiting.select("pattern", F.lit(True).alias("waits")), "pattern", "left")
        return marked.select(*(c for c in scores.columns if c not in ps), *(F.when(F.col("waits"), 0.0).otherwise(F.col(p)).alias(p) for p in ps))

    def speaking(self, edges: DataFrame) -> DataFrame:
        """The patterns that may have spoken at some scoring, by edges to all values that ever had any confidence."""
        return self._means(edges, self.highest).filter(" or ".join(f"p{k} >= {LIKELY}" for k in _KS)).select("pattern")

    def count(self, edges: DataFrame) -> None:
        """Lets the waiting patterns count all their confident values, by edges to all values of any confidence."""
        known = self.patterns.join(self.waiting.select("pattern"), "pattern", "left_anti")
        counts = self._means(edges, self.values).select("pattern", *(f"n{k}" for k in _KS), *(F.lit(0.0).alias(f"p{k}") for k in _KS))
        self.patterns = stage(known.unionByName(counts), "pattern-scores")
        self.staged.append(self.patterns)

    def _means(self, edges: DataFrame, values: DataFrame | None) -> DataFrame:
        """pattern, n0.. (confident values of each kind), p0.. (confidence for each kind, 0 where too few support it)."""
        own = edges
        if values is not None:
            own = _join(edges, values, "value", "pattern", "left")
        else:
            own = edges.select("*", *(F.lit(0.0).alias(f"v{k}") for k in _KS))
        conf = own.select("pattern", *(F.when(F.col("kind") == k, 1.0).when(F.col("kind") >= 0, 0.0).otherwise(F.coalesce(f"v{k}", F.lit(0.0))).alias(f"c{k}") for k in _KS))
        sums = conf.groupBy("pattern").agg(*(F.count(F.when(F.col(f"c{k}") >= self.s.value, 1)).alias(f"n{k}") for k in _KS), *(F.avg(f"c{k}").alias(f"a{k}") for k in _KS))
        return sums.select("pattern", *(F.col(f"n{k}") for k in _KS), *(F.when(F.col(f"n{k}") >= self.s.seeds, F.col(f"a{k}")).otherwise(0.0).alias(f"p{k}") for k in _KS))

    def _values(self, edges: DataFrame) -> DataFrame:
        """value, v0..: the confidence of each unknown value for each kind."""
        speaks = self.patterns.filter(" or ".join(f"p{k} >= {LIKELY}" for k in _KS))
        rows = _join(edges.filter("kind < 0"), speaks, "pattern", "value")
        err = lambda k: F.log(F.when(F.col(f"p{k}") >= LIKELY, F.greatest(1 - F.col(f"p{k}"), F.lit(1e-9))).otherwise(F.lit(1.0)))
        return rows.groupBy("value").agg(*((1 - F.exp(F.sum(err(k)))).alias(f"v{k}") for k in _KS))

    def usable(self) -> DataFrame:
        return _usable(self.patterns, self.s)

    def confident(self) -> DataFrame:
        """value, kind of the unknown values that are found."""
        best = F.greatest(*(F.col(f"v{k}") for k in _KS))
        kind = F.coalesce(*(F.when(F.col(f"v{k}") == best, F.lit(k)) for k in _KS))
        return self.values.filter(best >= self.s.value).select("value", kind.alias("kind"))

    def strong(self) -> DataFrame:
        """pattern, kind of the patterns that discover."""
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"p{k}").alias("p")) for k in _KS))).alias("x")
        return self.patterns.select("pattern", each).filter(F.col("x.p") >= self.s.pattern).select("pattern", F.col("x.kind").alias("kind"))


def _grown(docs: DataFrame, seeds: DataFrame, usable: DataFrame, count: int, confident: DataFrame | None, before: DataFrame | None, s: Settings) -> tuple[_Graph, list[DataFrame]]:
    """The scored graph of a round, and the staged tables that it is done with. Patterns wait while they are outnumbered by
    estimate; those that can't be proven silent at every scoring are let in, until none is. The scores are those of a graph
    with all edges of all usable patterns."""
    chosen, waiting = _divided(docs, usable, count)
    edges, old = seeds, []
    new = edges_of(docs, chosen, confident)
    while True:
        edges = stage(edges.unionByName(new.select("pattern", "value", F.lit(-1).alias("kind"))).groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
        left = waiting.count()
        graph = _Graph(edges, before, s, waiting if left else None)
        old += [chosen, waiting, edges]
        if not left:
            return graph, old + graph.staged
        evidence = evidence_of(docs, waiting, graph.highest, _slots(count)).select("pattern", "value", F.lit(-1).alias("kind"))
        pairs = stage(seeds.unionByName(evidence).join(waiting.select("pattern"), "pattern", "left_semi").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "evidence")
        chosen = stage(graph.speaking(pairs), "patterns")
        old.append(pairs)
        if not chosen.count():
            graph.count(pairs)
            return graph, old + [chosen] + graph.staged
        old += graph.staged
        waiting = stage(waiting.join(chosen, "pattern", "left_anti"), "patterns")
        new = edges_of(docs, chosen, None)


def discover(docs: DataFrame, scanned: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_key, extra), staged: the discovered spans of each text that has any, as an array of (start, kind, stop).

    Each round reads the texts three times, for the number of values in each pattern, for the edges of what is known so far
    and for the proof that patterns which wait can't speak, and twice more whenever some are let in; a last pass finds the
    places of the discovered values. The tokens of all texts are never kept.
    """
    spark = docs.sparkSession
    seeds = scanned.select(F.explode("mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.value", "m.kind")
    seeds = stage(seeds.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "seed-edges")
    per_kind = seeds.groupBy("pattern").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in _KS))
    usable = stage(_usable(per_kind, s), "usable-patterns")
    graph, confident, before, old = None, None, (usable.count(), 0), [seeds, usable]
    for _ in range(s.rounds if before[0] else 0):
        graph, done = _grown(docs, seeds, usable, before[0], confident, graph.values if graph else None, s)
        usable, confident = graph.usable(), graph.confident()
        old += done
        now = usable.count(), confident.count()
        if now == before:
            break
        before = now
    if graph is None or not before[1]:
        out = stage(no_rows(spark, "doc_id long, text_key long, extra " + _NO_SPANS), "discovered")
    else:
        at = places_of(docs, graph.strong(), confident).join(confident, "value").join(graph.strong(), ["pattern", "kind"], "left_semi")
        hits = at.select("doc_id", "text_key", "start", "kind", "stop").distinct()
        # written, so that the planner knows its size and need not move the texts for a few rows
        out = stage(hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("extra")), "discovered")
    unstage(*old)
    return out


def personal_data(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text).

    Counts and digest cover the base spans; spans lists base and discovered spans as kind:start:end, by start, then kind
    (code points, end exclusive). A null text is empty. Rows that repeat a doc_id, or have none, are handled one by one.
    Discovered spans never overlap base spans. Other columns are ignored; an empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    scanned = stage(scan(docs), "mentions")
    extra = discover(docs, scanned, s or Settings()).withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k")
    base = F.transform("mentions", lambda m: F.struct(m.start.alias("start"), m.kind.alias("kind"), m.stop.alias("stop")))
    both = F.array_sort(F.concat(base, F.coalesce("extra", F.array().cast(_NO_SPANS))))
    names = F.array(*(F.lit(k) for k in KINDS))
    said = F.array_join(F.transform(both, lambda m: F.concat_ws(":", F.element_at(names, m.kind + 1), m.start, m.stop)), ",")
    joined = scanned.join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", said.alias("spans"))


def redact(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, as [EMAIL]; other columns stay, and n_chars, where
    there is one, becomes the new length. Of overlapping spans the union is replaced, named after the first."""
    arrow_batches(docs.sparkSession)
    scanned = stage(scan(docs), "mentions")
    found = discover(docs, scanned, s or Settings())
    unstage(scanned)
    # base spans follow from the text; only what was discovered has to be joined
    d, k, x = (unused(c, docs) for c in ("of_doc", "of_text", "extra_spans"))
    found = found.select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("extra").alias(x))
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(k)), "left").drop(d, k)
    keep = docs.columns

    def run(batches):
        for rows, _, _ in text_slices(batches):
            out = []
            for text, more in zip(rows.column("text").to_pylist(), rows.column(x).to_pylist()):
                spans = sorted(base_spans(text or "") + [(m["start"], m["kind"], m["stop"]) for m in more or []])
                out.append(_replace(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else rows.column(c) for c in keep], names=keep)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in keep else out


def _replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])
