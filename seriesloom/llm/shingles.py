"""Word shingles as 64-bit hashes, for whole blocks of texts at once.

A text's words are the maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its shingles are the
runs of five words; a text of one to four words has its whole sequence as the only one; a text without words has none.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SHINGLE = 5
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_BYTE[65:91] = _BYTE[97:123]
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = int(_rng.integers(0, 2**63, dtype=U64)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=U64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept, since every block needs them."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, 1 << 16), b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _table(base: int) -> np.ndarray:
    out = np.full(STRETCH, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes that are worked on at a time. base**i and base**-i are the product of an entry for the stretch and one for the place
#: in it, so that the tables stay small however long a block is.
STRETCH = 1 << 16
_UP, _DOWN = _table(_BASE), _table(_BASE_INV)
_STRETCH_UP, _STRETCH_DOWN = pow(_BASE, STRETCH, 2**64), pow(_BASE_INV, STRETCH, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = _SEP[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_or(sep[:-1], cut[1:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_or(sep[1:], cut[1:-1], out=after[:-1])
    word = ~sep
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Values of bytes that tell upper and lower case apart.
EXACT = np.random.Generator(np.random.PCG64(99)).integers(0, 2**64, 256, dtype=U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A hash of each string, the same wherever it stands; A-Z count as lower case unless `values` says otherwise."""
    total = np.zeros(len(data) + 1, U64)
    up, down = 1, np.empty(len(data) // STRETCH + 1, U64)
    down[0], down[1:] = 1, _STRETCH_DOWN
    down = np.multiply.accumulate(down)
    for i in range(0, len(data), STRETCH):
        part = total[i + 1 : i + 1 + STRETCH]
        np.multiply(values[data[i : i + STRETCH]], _UP[: len(part)], out=part)
        part *= U64(up)
        np.cumsum(part, out=part)
        part += total[i]
        up = up * _STRETCH_UP % 2**64
    return mix((total[ends] - total[starts]) * (down[starts // STRETCH] * _DOWN[starts % STRETCH]) + (ends - starts).astype(U64))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles in text order (repeats included) and for each text the index of its first one (n + 1 entries)."""
    starts, ends, first = word_spans(data, offsets)
    h, counts = word_hashes(data, starts, ends), np.diff(first)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    out = np.empty(at[-1], U64)
    if len(h) >= SHINGLE:
        all5 = np.zeros(len(h) - SHINGLE + 1, U64)
        for k in range(SHINGLE):
            all5 += h[k : len(h) - SHINGLE + 1 + k] * _PLACE[k]
        full = counts >= SHINGLE
        src = np.repeat(first[:-1][full] - at[:-1][full], n[full]) + np.flatnonzero(np.repeat(full, n))
        out[np.repeat(full, n)] = mix(all5[src])
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        w = h[first[i] : first[i + 1]]
        out[at[i]] = mix((w * _PLACE[: len(w)]).sum(dtype=U64, keepdims=True) + U64(len(w)))[0]
    return out, at


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted set of shingles."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    out = np.zeros(len(at), np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return (np.concatenate(sets) if sets else hashes[:0]), out


class MinHash:
    """k minimum values per set, from odd multipliers of the upper half of each shingle's hash."""

    def __init__(self, k: int, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        self.k = k
        self.a = (r.integers(0, 2**31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = r.integers(0, 2**32, k, dtype=np.uint32)

    def values(self, hashes: np.ndarray, i: int) -> np.ndarray:
        return (hashes >> U64(32)).astype(np.uint32) * self.a[i] + self.b[i]

    def signatures(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(sets, k) uint32; a set without shingles has only maximal values."""
        out = np.full((len(at) - 1, self.k), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            h32 = (hashes >> U64(32)).astype(np.uint32)
            v = np.empty_like(h32)
            for i in range(self.k):
                np.multiply(h32, self.a[i], out=v)
                v += self.b[i]
                out[full, i] = np.minimum.reduceat(v, at[full])
        return out
