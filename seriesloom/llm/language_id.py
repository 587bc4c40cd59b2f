"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors.

Text likelihoods come from naive Bayes over hashed byte trigrams of letters, fitted on a bounded sample of labelled
texts, and are tempered: a text counts as at most `most_grams` independent trigrams, since neighbouring ones aren't.
The other evidence is learned from the corpus itself by grouped aggregation of the text posteriors of all rows: how
often each declared language and each address suffix goes with each language, and how the languages spread over the
whole corpus, over a site's domain and over a host. The host's prior is smoothed by its domain's and that by the global
one; a row's own posterior is taken out of its host's and domain's sums, so a row is no evidence for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FINE_BYTES, arrow_batches, by_key, byte_view, shuffle_partitions, stage, text_slices, unused

_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_TAGS = re.compile(r"<(script|style)\b[^>]*>[^<]*|<[^>]*>|&[a-z0-9#]{1,8};", re.I)


@dataclass(frozen=True)
class Settings:
    """bits: 2**bits buckets of trigrams. sample_rows: bound on the labelled rows used for fitting. most_grams: trigrams
    that a text counts as at most. strength: pseudo-rows of each smoothing level. least: confidence below which a row is
    rejected. doubt: share of declarations and suffixes taken to be arbitrary."""

    bits: int = 15
    sample_rows: int = 20_000
    most_grams: float = 60.0
    strength: float = 5.0
    least: float = 0.5
    doubt: float = 0.05


def trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams that hold a letter, and the row of each."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LETTER[data]
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    ok = code != 0x202020
    for cut in (1, 2):
        at = offsets[1:-1] - cut
        ok[at[(at >= 0) & (at < len(ok))]] = False
    where = np.flatnonzero(ok)
    bucket = ((code[where] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
    return bucket, np.searchsorted(offsets, where, "right") - 1


class Model:
    """Languages and their log-probabilities of the buckets, (languages, 2**bits) float32."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + 0.5
        self.log = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)

    def likelihoods(self, data, offsets, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods (rows, languages) and the number of trigrams with letters."""
        bucket, row = trigrams(data, offsets, s.bits)
        n = len(offsets) - 1
        grams = np.bincount(row, minlength=n)
        scale = np.minimum(1.0, s.most_grams / np.maximum(grams, 1))
        out = np.stack([np.bincount(row, w[bucket], n) for w in self.log], 1) if len(self.languages) else np.zeros((n, 0))
        return out * scale[:, None], grams


def fit(labelled: DataFrame, s: Settings | None = None) -> Model:
    """A model from rows (doc_id, text, lang); null texts and languages are left out. About sample_rows rows are used
    at most, each chosen by a seeded draw of its own, so that repeated ids aren't taken together."""
    s = s or Settings()
    arrow_batches(labelled.sparkSession)
    labelled = labelled.filter("lang is not null and text is not null")
    total = labelled.select("lang").count()
    keep = F.lit(True) if total <= s.sample_rows else F.rand(3) < s.sample_rows / total

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for rows, data, offsets in text_slices(batches, size=FINE_BYTES):
            bucket, row = trigrams(data, offsets, s.bits)
            names, number = np.unique(np.array(rows.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for i, name in enumerate(names.tolist()):
                counts.setdefault(name, np.zeros(1 << s.bits, np.int64))
                counts[name] += np.bincount(bucket[number[row] == i], minlength=1 << s.bits)
        for name, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c.tobytes()], pa.binary())], names=["lang", "counts"])

    def add(groups):
        for g in groups:
            total = sum(np.frombuffer(x, np.int64) for x in g.column("counts").to_pylist())
            yield pa.RecordBatch.from_arrays([g.column("lang").combine_chunks().slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    schema = "lang string, counts binary"
    parts = labelled.filter(keep).select("text", "lang").mapInArrow(run, schema)
    got = {r.lang: np.frombuffer(r.counts, np.int64) for r in by_key(parts, shuffle_partitions(labelled.sparkSession), ["lang"], add, schema).collect()}  # one row a language
    names = sorted(got)
    return Model(names, np.stack([got[x] for x in names]).astype(float) if names else np.zeros((0, 1 << s.bits)))


def page_columns(pages: DataFrame) -> DataFrame:
    """page_id as key, html as text, and the evidence of a web page: host, domain (its last two labels), suffix (last
    label, and a two-letter first path segment where there is one) and the language that the markup declares."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    none = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").cast("long").alias("key"),
        F.col("html").alias("text"),
        none(host).alias("host"),
        none(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        none(F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), none(path))).alias("suffix"),
        none(declared).alias("declared"),
    )


def _likelihoods(rows: DataFrame, model: Model, s: Settings, markup: bool, names: list[str]) -> DataFrame:
    """rows without text, with log-likelihoods, the posterior of the text alone and the number of trigrams, as `names`."""
    keep = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, data, offsets in text_slices(batches, size=FINE_BYTES):
            if markup:
                data, offsets = byte_view(pa.array([_TAGS.sub(" ", t or "") for t in part.column("text").to_pylist()], pa.string()))
            ll, grams = shared.value.likelihoods(data, offsets, s)
            p = np.where(grams[:, None] > 0, _softmax(ll), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _lists(ll), _lists(p), pa.array(grams)], names=[*keep, *names])

    schema = rows.select(*keep, F.array(F.lit(0.0)).alias(names[0]), F.array(F.lit(0.0)).alias(names[1]), F.lit(0).cast("long").alias(names[2])).schema
    return rows.select(*keep, "text").mapInArrow(run, schema)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _lists(x: np.ndarray) -> pa.ListArray:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x).ravel()))


def _matrix(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as rows of k numbers, nulls as zeros, and which rows aren't null."""
    there = ~np.asarray(col.is_null())
    out = np.zeros((len(col), k))
    out[there] = col.flatten().to_numpy().reshape(-1, k)
    return out, there


def fuse(ll: np.ndarray, own: np.ndarray, host, domain, declared, suffix, world: np.ndarray, s: Settings) -> np.ndarray:
    """Posterior of each row and language. host, domain, declared, suffix: (sums, present), own: the row's share of the
    first two; world: the languages' shares in the whole corpus."""
    rest = lambda x: np.where(x[1][:, None], np.maximum(x[0] - own, 0), 0)
    smooth = lambda n, to: (n + s.strength * to) / (n.sum(1, keepdims=True) + s.strength)
    prior = smooth(rest(host), smooth(rest(domain), world))
    out = ll + np.log(prior)
    for sums, there in (declared, suffix):
        out += np.where(there[:, None], np.log((1 - s.doubt) * smooth(sums, world) / world + s.doubt), 0)
    return _softmax(out)


def identify(rows: DataFrame, model: Model, s: Settings | None = None, markup: bool = False) -> DataFrame:
    """rows (text, host, domain, suffix, declared and any others) without text and evidence, plus lang, confidence and
    accepted.

    Null evidence has no say: a null host or domain leaves the next wider prior, a null declaration or suffix no factor.
    Rows without letters (null and empty texts too) are judged by the other evidence but never accepted; all others are
    accepted from a confidence of `least`. Without any language in the model lang is null and nothing is accepted.
    """
    s = s or Settings()
    k = len(model.languages)
    others = [c for c in rows.columns if c not in ("text", "host", "domain", "suffix", "declared", "lang", "confidence", "accepted")]
    if not k:
        return rows.select(*others, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("accepted"))
    arrow_batches(rows.sparkSession)
    ll, p, grams = (unused(c, rows) for c in ("log_likelihoods", "posterior", "trigrams"))
    scored = stage(_likelihoods(rows, model, s, markup, [ll, p, grams]), "likelihoods")

    def sums(by: str, name: str) -> DataFrame:
        """Written first, so that the planner knows its size: few keys are broadcast, many are joined by shuffle."""
        return stage(scored.filter(F.col(by).isNotNull()).groupBy(by).agg(F.array(*(F.sum(F.col(p)[i]) for i in range(k))).alias(name)), f"sums-{by}")

    total = scored.agg(*(F.coalesce(F.sum(F.col(p)[i]), F.lit(0.0)) for i in range(k))).first()
    world = (np.array(total) + 1) / (sum(total) + k)
    evidence = {by: unused(f"{by}_sums", rows) for by in ("host", "domain", "declared", "suffix")}
    joined = scored
    for by, name in evidence.items():
        joined = joined.join(sums(by, name), by, "left")
    joined = joined.select(*others, ll, p, grams, *evidence.values())
    names = np.array(model.languages, object)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (text, _), (own, _), *rest = (_matrix(batch.column(c), k) for c in (ll, p, *evidence.values()))
            post = fuse(text, own, *rest, world, s)
            best = post.argmax(1)
            sure = post[np.arange(len(best)), best]
            accepted = (batch.column(grams).to_numpy() > 0) & (sure >= s.least)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(names[best].tolist(), pa.string()), pa.array(sure), pa.array(accepted)], names=[*others, "lang", "confidence", "accepted"])

    return joined.mapInArrow(run, scored.select(*others, F.lit("").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("accepted")).schema)


def identify_pages(pages: DataFrame, labelled: DataFrame, s: Settings | None = None) -> DataFrame:
    """page_id, lang, confidence, accepted for each page (page_id, url, html); the text model is fitted on labelled
    (doc_id, text, lang). Repeated rows are judged row by row; nulls as in identify()."""
    return identify(page_columns(pages), fit(labelled, s), s, markup=True).withColumnRenamed("key", "page_id")


def keep_identified(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of docs whose language is accepted, with all their columns; source stands for the host and the lang
    column for the declared language, and rows with a lang label are what the text model is fitted on."""
    none = F.lit(None).cast("string")
    inner = docs.select("text", F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"), F.col("lang").alias("declared"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    # the few rejected rows are written first, so that the planner knows their size and need not move the texts
    bad = stage(identify(inner, fit(docs, s), s).filter("not accepted").select("_id", "_t").distinct(), "rejected")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["_t"]), "left_anti")
