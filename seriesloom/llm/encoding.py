"""BPE encoding and decoding of whole documents on the executors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteTextMachine, Pieces, TextMachine, Transducer
from .common import CHUNK_BYTES, arrow_batches, text_pieces

_coders: dict[str, tuple] = {}


def coder(path: str) -> tuple[Transducer, TextMachine, Pieces]:
    """One encoder, decoder and table of decimal ids per tokenizer and Python worker, kept over its tasks."""
    if path not in _coders:
        t = Transducer(path)
        _coders[path] = t, TextMachine(t.merges.names), Pieces({i: b" %d" % i for i in t.merges.names})
    return _coders[path]


def id_runs(t: Transducer, batches, piece: int):
    """(batch, runs, ids, offsets): for pieces of texts the ids that they settle. runs holds (row, first, last) of each; a
    text of several pieces has several runs, one after the other."""
    state = None
    for batch, pieces in text_pieces(batches, size=piece):
        cut = [i for i, (_, _, first, last) in enumerate(pieces) if not (first and last)]
        whole = [p for p in pieces if p[2] and p[3]]
        ids, at = t.encode([text for _, text, _, _ in whole])
        if not cut:
            yield batch, [(row, True, True) for row, _, _, _ in whole], ids, at
            continue
        # a block holds one text that goes on from the last block at most, and one that goes on to the next
        out, k = [], 0
        for i, (_, text, first, last) in enumerate(pieces):
            if first and last:
                out.append(ids[at[k] : at[k + 1]])
                k += 1
            else:
                new, state = t.feed(None if first else state, text, last)
                out.append(new)
        offsets = np.zeros(len(out) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=offsets[1:])
        yield batch, [(row, first, last) for row, _, first, last in pieces], np.concatenate(out), offsets


def encode(docs: DataFrame, path: str, piece: int = CHUNK_BYTES) -> DataFrame:
    """docs without text, and with ids array<int> and n_tokens long instead; a null or empty text has no ids.

    Columns of docs that are called ids or n_tokens are replaced. Rows may repeat; an empty table gives an empty one. Texts
    are read in pieces of `piece` bytes.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens")
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        t, _, _ = coder(path)
        open_: list[np.ndarray] = []
        for batch, runs, ids, at in id_runs(t, batches, piece):
            rows, lists = [], []
            for (row, first, last), a, b in zip(runs, at.tolist(), at[1:].tolist()):
                open_ = [ids[a:b]] if first else [*open_, ids[a:b]]
                if last:
                    rows.append(row)
                    lists.append(np.concatenate(open_))
            if rows:
                n = np.zeros(len(rows) + 1, np.int64)
                np.cumsum([len(x) for x in lists], out=n[1:])
                part = batch.select(keep).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(np.concatenate(lists))), pa.array(np.diff(n))], names=[*keep, "ids", "n_tokens"])

    schema = docs.select(*keep, F.array(F.lit(0)).alias("ids"), F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """encoded with a column decoded: the library's spelling (tokens joined by a space), or with plain=True the text that
    the incremental byte machine restores. Null ids give an empty string."""
    arrow_batches(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    keep = encoded.columns

    def run(batches):
        t, library, _ = coder(path)
        machine = TextMachine(t.merges.names, set(t.merges.special.values()), plain=True) if plain else library
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                ids = np.asarray(ids.values if ids.is_valid else [], np.int64)
                parts = [ids[i : i + (1 << 16)] for i in range(0, len(ids), 1 << 16)]
                m = machine.copy()
                if plain:
                    whole = ByteTextMachine(m)
                    out.append("".join(map(whole.feed, parts)) + whole.finish())
                else:
                    out.append(b"".join(map(m.feed, parts)).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*keep, "decoded"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("decoded")).schema)


class _Digest:
    """A text's running digests: of its ids as decimals, and of what the decoder makes of them."""

    def __init__(self, machine: TextMachine):
        self.n, self.ids, self.text, self.machine = 0, hashlib.sha256(), hashlib.sha256(), machine.copy()


def round_trip_digests(docs: DataFrame, path: str, piece: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is streamed through the encoder and its ids, as they become
    stable, through the decoder and into the digests, so neither ids nor decoded text are ever held whole.

    A null or empty text has no ids and the digests of empty strings. Rows that repeat a doc_id, or have none, are handled
    one by one; other columns are ignored; an empty table gives an empty result. Texts are read in pieces of `piece` bytes.
    """
    arrow_batches(docs.sparkSession)

    def run(batches):
        t, machine, decimal = coder(path)
        open_ = None
        for batch, runs, ids, at in id_runs(t, batches, piece):
            states = []
            for _, first, _ in runs:
                open_ = _Digest(machine) if first else open_
                states.append(open_)
            text, numbers = machine.feed_runs(ids, at, [x.machine for x in states]), decimal.spell(ids, at)
            for x, raw, said, n in zip(states, numbers, text, np.diff(at).tolist()):
                x.ids.update(raw if x.n else raw[1:])
                x.text.update(said)
                x.n += n
            done = [(row, x) for (row, _, last), x in zip(runs, states) if last]
            if done:
                ids_ = batch.column("doc_id").take(pa.array([row for row, _ in done]))
                yield pa.RecordBatch.from_arrays([ids_, pa.array([x.n for _, x in done], pa.int64()), pa.array([x.ids.hexdigest() for _, x in done]), pa.array([x.text.hexdigest() for _, x in done])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
