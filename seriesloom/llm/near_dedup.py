"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes its set of five-word shingles and a MinHash signature; texts with the same set form a class whose
   smallest id stands for it, so exact copies cost one row each and never meet in pairs.
2. Signature bands of the classes are grouped into buckets. Each member of a bucket is first compared with one hub, its
   smallest digest: a bucket of near copies is connected by as many pairs as it has members.
3. Only buckets with members that no link has connected to the hub go on. There, pairs of different components are
   compared, in blocks of bounded size: the unconnected members with each other and with the hub's component. A pair that
   shares several buckets is compared in the first one alone.
4. Signatures are compared batch by batch. After each batch the posterior of the similarity (uniform prior, binomial
   evidence) prunes pairs whose chance of reaching the threshold is under `miss`. Only the texts of survivors are fetched;
   they are verified on whole shingle sets, most similar first, skipping pairs that verified links already connect.
5. Components of the verified links give the classes. Versions of one doc_id are linked whatever they hold.

Only links that the exact check confirms are used. A pair at the threshold escapes all bands with a chance under `miss`.
A hub's members are dealt out in salted runs, which pass through a task one batch at a time.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bit_filter, by_key, byte_view, flagged, shuffle_partitions, stage, text_slices, unstage
from .graph import components
from .shingles import MinHash, distinct, mix, shingle_hashes

SIGNATURES = "doc_id long, text_key long, n_shingles long, digest binary, signature binary"
LINKS = "u long, v long"


@dataclass(frozen=True)
class Settings:
    """percent: links need 100 * intersection >= percent * union. rows: minimum values of a band. miss: chance of
    losing a pair at the threshold, in the bands and in the Bayesian pruning. batch: signature values compared at a
    time. block: members of one side of a comparison task, on average. fan: members of a hub in one run, on average."""

    percent: int = 85
    rows: int = 6
    miss: float = 1e-5
    batch: int = 30
    block: int = 256
    fan: int = 128

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def values(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared so far, fewest matches with which a pair goes on), from the posterior tail
        P(similarity >= threshold | matches) of the Beta(1 + m, 1 + n - m) posterior."""
        x = (np.arange(20000) + 0.5) / 20000
        tail = x >= self.percent / 100
        out = []
        for n in [*range(self.batch, self.values, self.batch), self.values]:
            m = 0
            while m < n:
                logp = m * np.log(x) + (n - m) * np.log1p(-x)
                p = np.exp(logp - logp.max())
                if p[tail].sum() / p.sum() >= self.miss:
                    break
                m += 1
            out.append((n, m))
        return out


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """Set size, a digest of the set and the signature of each document; null and empty texts have size 0."""
    k = s.values

    def run(batches):
        family = MinHash(k)
        for rows, data, offsets in text_slices(batches):
            h, at = distinct(*shingle_hashes(data, offsets))
            sig = family.signatures(h, at)
            digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "text_key", "n_shingles", "digest", "signature"])

    return _keyed(docs).mapInArrow(run, SIGNATURES)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _bands(classes: DataFrame, s: Settings) -> DataFrame:
    """(digest, band, key) for each band of each class; the key holds the band's number and its values' hash."""
    r, b = s.rows, s.bands

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = byte_view(batch.column("signature"))
            sig = data.view(np.uint32).reshape(batch.num_rows, r * b).astype(np.uint64)
            digests = batch.column("digest")
            for i in range(b):
                key = np.full(batch.num_rows, i + 1, np.uint64)
                for j in range(r):
                    key = mix(key + sig[:, i * r + j])
                yield pa.RecordBatch.from_arrays([digests, pa.array(np.full(batch.num_rows, i, np.int32)), pa.array(key.view(np.int64))], names=["digest", "band", "key"])

    return classes.select("digest", "signature").mapInArrow(run, "digest binary, band int, key long")


def _runs(stars: DataFrame, payload: DataFrame, s: Settings) -> DataFrame:
    """(hub, salt, node, ...): the rows of payload (digest, ...) of every hub, with a null node, before those of its members;
    a hub of many members has several runs, each with the hub's row at its head."""
    salts = stage(stars.groupBy("hub").agg(F.ceil(F.count("*") / s.fan).cast("int").alias("salts")), "salts")
    others = [c for c in payload.columns if c != "digest"]
    hubs = salts.withColumnRenamed("hub", "digest").join(payload, "digest").select(F.col("digest").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("node"), *others)
    members = stars.join(salts, "hub").withColumnRenamed("node", "digest").join(payload, "digest").select("hub", F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int").alias("salt"), F.col("digest").alias("node"), *others)
    return hubs.unionByName(members).repartition(shuffle_partitions(stars.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "node")


def _star_survivors(stars: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The stars (hub, node) that the posterior bounds leave."""
    least, k = s.least_matches(), s.values

    def run(batches):
        before = np.zeros((1, k), np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = byte_view(batch.column("signature"))[0].view(np.uint32).reshape(-1, k)
            head = np.asarray(batch.column("node").is_null())
            hub_at = np.maximum.accumulate(np.where(head, np.arange(len(head)) + 1, 0))  # 0: the hub of the batch before
            known = np.concatenate([before, sig])
            at = np.flatnonzero(~head)
            matches, done = np.zeros(len(at), np.int32), 0
            for upto, need in least:
                matches += (sig[at, done:upto] == known[hub_at[at], done:upto]).sum(1, dtype=np.int32)
                keep = matches >= need
                at, matches, done = at[keep], matches[keep], upto
            before = known[hub_at[-1:]]
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("hub", "node")], names=["hub", "node"])

    return _runs(stars, classes.select("digest", "signature"), s).mapInArrow(run, "hub binary, node binary")


def _similar(a: np.ndarray, b: np.ndarray, s: Settings) -> bool:
    if 100 * min(len(a), len(b)) < s.percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= s.percent * (len(a) + len(b) - both)


def _star_links(stars: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(u, v): the stars that the exact check confirms, as document ids; a run passes through one batch at a time."""

    def run(batches):
        hub, own = None, None
        for rows, data, offsets in text_slices(batches):
            h, at = distinct(*shingle_hashes(data, offsets))
            u, v = [], []
            for i, (head, doc) in enumerate(zip(np.asarray(rows.column("node").is_null()), rows.column("doc_id").to_pylist())):
                one = h[at[i] : at[i + 1]]
                if head:
                    hub, own = doc, one.copy()
                elif _similar(own, one, s):
                    u.append(hub)
                    v.append(doc)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return _runs(stars, texts, s).mapInArrow(run, LINKS)


def _tasks(bands: DataFrame, hubs: DataFrame, classes: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """(key, i, j, side, band, node, doc_id, component, signature): who meets whom in the buckets whose members the stars
    haven't connected. Blocks of unconnected members come first, those of the hub's component after them."""
    known = classes.select("digest", "doc_id", "signature").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    groups = stage(known.select("digest", "component"), "class-components")
    inside = bands.join(hubs.filter("n > 2"), "key").join(groups, "digest").join(groups.select(F.col("digest").alias("hub"), F.col("component").alias("of_hub")), "hub")
    inside = stage(inside.filter("digest <> hub").select("key", "band", "digest", (F.col("component") != F.col("of_hub")).alias("open")), "bucket-members")
    sizes = inside.groupBy("key").agg(F.count(F.when(F.col("open"), 1)).alias("r"), F.count("*").alias("n")).filter("r > 0 and n > 1")
    sizes = stage(sizes.select("key", F.ceil(F.col("r") / s.block).cast("int").alias("p"), F.ceil((F.col("n") - F.col("r")) / s.block).cast("int").alias("q")), "bucket-sizes")
    deal = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    p, q = F.col("p"), F.col("q")
    placed = inside.join(sizes, "key").withColumn("own", F.when(F.col("open"), deal(p)).otherwise(p + deal(F.greatest(q, F.lit(1)))))
    own, last = F.col("own"), p + q - 1
    left = F.when(F.col("open"), F.transform(F.sequence(own, last), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    before = F.when(F.col("open"), own).otherwise(p)
    right = F.when(before > 0, F.transform(F.sequence(F.lit(0), before - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(1).alias("side"))))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    dealt = placed.select("key", "band", "digest", F.explode(F.concat(F.coalesce(left, none), F.coalesce(right, none))).alias("x")).select("key", "band", "digest", "x.*")
    return dealt.join(known, "digest").select("key", "i", "j", "side", "band", F.col("digest").alias("node"), "component", "signature")


def _prune(groups, s: Settings):
    """For each task the nodes of pairs that the posterior bounds leave, each with its place, and one row with the pairs of
    places and their matches."""
    least, r, k = s.least_matches(), s.rows, s.values
    for t in groups:
        if t.num_rows < 2:
            continue
        t = t.combine_chunks()
        side, component = t.column("side").to_numpy(), t.column("component").to_numpy()
        sig = byte_view(t.column("signature"))[0].view(np.uint32).reshape(-1, k)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one_block = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        found = []
        for a in range(0, len(left), 32):
            x, y = (m.ravel() for m in np.meshgrid(left[a : a + 32], left if one_block else right, indexing="ij"))
            keep = component[x] != component[y]
            if one_block:
                keep &= x < y
            x, y = x[keep], y[keep]
            m, done = np.zeros(len(x), np.int32), 0
            for upto, need in least:
                if not len(x):
                    break
                m += (sig[x, done:upto] == sig[y, done:upto]).sum(1, dtype=np.int32)
                keep = m >= need
                x, y, m, done = x[keep], y[keep], m[keep], upto
            if len(x):
                early = t.column("band")[0].as_py() * r  # an earlier bucket has seen the pair
                if early:
                    keep = ~(sig[x, :early] == sig[y, :early]).reshape(len(x), -1, r).all(2).any(1)
                    x, y, m = x[keep], y[keep], m[keep]
                found.append(np.column_stack([x, y, m]))
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if not len(found):
            continue
        used = np.unique(found[:, :2])
        n = len(used) + 1
        same = [pa.array([t.column(c)[0].as_py()] * n, kind) for c, kind in (("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
        yield pa.RecordBatch.from_arrays([*same, pa.array([None, *t.column("node").take(pa.array(used)).to_pylist()], pa.binary()), pa.array([-1, *used.tolist()], pa.int32()), pa.array([found.astype("<i4").tobytes()] + [None] * len(used), pa.binary())], names=["key", "i", "j", "node", "place", "pairs"])


PRUNED = "key long, i int, j int, node binary, place int, pairs binary"


def _sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingle_hashes(*byte_view(text)))


def _verify(groups, s: Settings):
    """Links of each task that the exact check confirms, enough of them to connect all that are linked."""
    for t in groups:
        t = t.combine_chunks().sort_by("place")
        pairs = np.frombuffer(t.column("pairs")[0].as_py(), "<i4").reshape(-1, 3)
        ids, places = t.column("doc_id").to_numpy(), t.column("place").to_numpy()
        h, at = _sets(t.column("text"))
        row = np.zeros(places.max() + 1, np.int64)
        row[places[1:]] = np.arange(1, len(places))
        parent = list(range(len(places)))

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        u, v = [], []
        for p in np.argsort(-pairs[:, 2], kind="stable").tolist():
            x, y = int(row[pairs[p, 0]]), int(row[pairs[p, 1]])
            if (rx := root(x)) == (ry := root(y)):
                continue
            if _similar(h[at[x] : at[x + 1]], h[at[y] : at[y + 1]], s):
                parent[max(rx, ry)] = min(rx, ry)
                u.append(int(ids[x]))
                v.append(int(ids[y]))
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs that stand in wanted (doc_id, text_key). A bit filter of bounded size goes ahead of the join, so that
    hardly any other text is moved."""
    bits = min(max(1 << 20, 1 << (16 * wanted.count()).bit_length()), 1 << 26)
    mark = F.xxhash64("doc_id", "text_key")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(mark.alias("mark")), "mark", bits))

    def run(batches):
        for batch in batches:
            hit = flagged(shared.value, batch.column("mark").to_numpy() & (bits - 1))
            if hit.any():
                yield batch.filter(pa.array(hit)).select(["doc_id", "text_key", "text"])

    few = _keyed(docs).withColumn("mark", mark).mapInArrow(run, "doc_id long, text_key long, text string")
    return few.join(wanted, ["doc_id", "text_key"])


def near_duplicates(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links with 100 * intersection >= percent * union of the shingle
    sets; kept marks that document. A text without words has n_shingles 0, is linked with nothing and is kept. A null
    doc_id has a null component and kept false. Rows that repeat a doc_id are versions of one document: all their links
    count for it, and all its rows have its component. An empty table gives an empty result.
    """
    s = s or Settings()
    if s.batch % s.rows:
        raise ValueError("batch has to be a multiple of rows")
    spark = docs.sparkSession
    arrow_batches(spark)
    n = shuffle_partitions(spark)
    sig = stage(signatures(docs, s), "signatures")
    named = sig.filter("doc_id is not null")
    full = named.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "signature")).alias("r")).select("digest", "r.doc_id", "r.text_key", "r.signature")
    classes = stage(classes, "classes-of-copies")
    bands = stage(_bands(classes, s), "bands")
    hubs = stage(bands.groupBy("key").agg(F.min("digest").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    # one row a document with several versions; few, as a rule, so written before it is joined
    versions = stage(named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id"), "versions")
    own = full.join(versions, "doc_id").select("digest", F.col("doc_id").alias("u")).join(classes.select("digest", F.col("doc_id").alias("v")), "digest").select("u", "v")

    def texts(nodes: DataFrame) -> DataFrame:
        """(digest, doc_id, text) of the nodes (digest), one row each."""
        wanted = stage(nodes.distinct().join(classes.select("digest", "doc_id", "text_key"), "digest"), "wanted")
        return _fetch(docs, wanted).dropDuplicates(["digest"]).select("digest", "doc_id", "text")

    stars = stage(bands.join(hubs, "key").filter("digest <> hub").select("hub", F.col("digest").alias("node")).distinct(), "stars")
    left = stage(_star_survivors(stars, classes, s), "star-survivors")
    near = stage(texts(left.select(F.col("hub").alias("digest")).unionByName(left.select(F.col("node").alias("digest")))), "star-texts")
    links = stage(_star_links(left, near, s).unionByName(own), "star-links")
    found = stage(components(links, "star-components"), "connected")
    open_ = stage(by_key(_tasks(bands, hubs, classes, found, s), n, ["key", "i", "j"], lambda g: _prune(g, s), PRUNED), "open-pairs")
    rest = open_.join(texts(open_.filter("node is not null").select(F.col("node").alias("digest"))).withColumnRenamed("digest", "node"), "node", "left")
    more = stage(by_key(rest.select("key", "i", "j", "place", "pairs", "doc_id", "text"), n, ["key", "i", "j"], lambda g: _verify(g, s), LINKS), "links")
    all_ = found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)
    last = stage(components(all_, "classes"), "classes")
    unstage(bands, hubs, stars, left, near, links, open_, more)
    by_digest = classes.select("digest", F.col("doc_id").alias("id")).join(last, "id", "left").select("digest", F.coalesce("component", "id").alias("of_class"))
    by_version = versions.withColumnRenamed("doc_id", "id").join(last, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("of_version"))
    out = sig.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(by_digest, "digest", "left").join(by_version, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_version", "of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
