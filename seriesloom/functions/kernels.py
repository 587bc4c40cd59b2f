"""Numpy kernels over many candidates at once: distances, envelopes, bounds and top-k."""

from __future__ import annotations

import numpy as np


def windows(values: np.ndarray, length: int) -> np.ndarray:
    """All subsequences as a view (n - length + 1, length)."""
    if len(values) < length:
        return np.zeros((0, length))
    return np.lib.stride_tricks.sliding_window_view(values, length)


def squared_euclid(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c - q) ** 2).sum(1)


def manhattan(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.abs(c - q).sum(1)


def dtw(q: np.ndarray, c: np.ndarray, band: int | None = None) -> np.ndarray:
    """Banded DTW of q against every row of c. The table is walked cell by cell, each cell a vector over the rows."""
    n, m = len(q), c.shape[1]
    r = max(n, m) if band is None else band
    inf = np.full(len(c), np.inf)
    prev = [inf] * (n + 1)
    prev[0] = np.zeros(len(c))
    for j in range(1, m + 1):
        now = [inf] * (n + 1)
        x = c[:, j - 1]
        for i in range(max(1, j - r), min(n, j + r) + 1):
            now[i] = (x - q[i - 1]) ** 2 + np.minimum(np.minimum(now[i - 1], prev[i]), prev[i - 1])
        prev = now
    return prev[n]


def envelope(a: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower envelope: extremes within r places, clipped at the ends."""
    if not len(a):
        return a, a
    up = windows(np.pad(a, r, constant_values=-np.inf), 2 * r + 1).max(1)
    lo = windows(np.pad(a, r, constant_values=np.inf), 2 * r + 1).min(1)
    return up, lo


def outside(x: np.ndarray, up: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Squared distance of x to the band between lo and up."""
    return np.where(x > up, (x - up) ** 2, np.where(x < lo, (lo - x) ** 2, 0.0))


def lower_bounds(values: np.ndarray, query: np.ndarray, lengths: list[int], r: int, w: int, mode: str = "both", context: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """LB_Keogh of every start for the suffixes of the query of all lengths, shared over the lengths.

    Bounds are summed over the whole windows of w points that tile each suffix from the query's end; the windows' bounds
    against all data places are computed once, and longer suffixes add windows to shorter ones. A length that isn't a
    multiple of w uses its largest tiled part. mode: d2q (data against the query's envelope), q2d or both (the larger).
    context: envelope of the data, where it is wider than values themselves.
    """
    n, m = len(values), len(query)
    qu, ql = envelope(query, r)
    du, dl = context if context is not None else envelope(values, r)
    out = {}
    longest = max(lengths)
    sums_d = sums_q = None
    done = 0
    for length in sorted(lengths):
        tiles = length // w
        while done < tiles:
            p = m - (done + 1) * w  # the window's place in the query; its place in the data is start + p - (m - length)
            d = np.zeros(max(0, n - w + 1))
            e = np.zeros(max(0, n - w + 1))
            for u in range(w):
                x = slice(u, u + len(d))
                d += outside(values[x], qu[p + u], ql[p + u])
                e += outside(np.full(len(d), query[p + u]), du[x], dl[x])
            # indexed by the place just after the suffix, so that all lengths share the sums
            end = np.arange(len(d)) + w * (done + 1)
            if sums_d is None:
                sums_d, sums_q = np.zeros(n + longest + w + 1), np.zeros(n + longest + w + 1)
            sums_d[end] += d
            sums_q[end] += e
            done += 1
        starts = np.arange(max(0, n - length + 1))
        if sums_d is None:
            out[length] = np.zeros(len(starts))
            continue
        d, e = sums_d[starts + length], sums_q[starts + length]
        out[length] = {"d2q": d, "q2d": e}.get(mode, np.maximum(d, e)).copy()
    return out


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest values, ascending, ties by place."""
    if k >= len(values):
        return np.argsort(values, kind="stable")
    cut = np.partition(values, k - 1)[k - 1]
    at = np.flatnonzero(values <= cut)
    return at[np.argsort(values[at], kind="stable")][:k]


def top_k(values: np.ndarray, query: np.ndarray, lengths: list[int], k: int, r: int, w: int, allowed=None, limit: dict[int, float] | None = None, mode: str = "both", context=None) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """length -> (starts, distances, verified): the k nearest subsequences under banded DTW, exactly.

    The k smallest bounds are verified first; the k-th true distance, or a smaller limit known from elsewhere, is the
    threshold, and only starts whose bound doesn't exceed it are verified. allowed masks starts out, for all lengths or
    by length.
    """
    bounds = lower_bounds(values, query, lengths, r, w, mode, context)
    return {length: bounded_top_k(values, query, length, k, r, bounds[length], _free(bounds[length], allowed, length), (limit or {}).get(length, np.inf)) for length in lengths}


def bounded_top_k(values: np.ndarray, query: np.ndarray, length: int, k: int, r: int, lb: np.ndarray, starts: np.ndarray, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(starts, distances, verified) of one length, from bounds of all its starts and those that may be used."""
    first, d = _first(values, query, length, k, r, lb, starts)
    tau = min(np.sort(d)[k - 1] if len(d) >= k else np.inf, limit)
    open_ = starts[lb[starts] <= tau * (1 + 1e-12)]
    rest = open_[~np.isin(open_, first)]
    q, c = query[len(query) - length :], windows(values, length)
    more = [dtw(q, c[rest[a : a + 4096]], r) for a in range(0, len(rest), 4096)]
    at, d = np.concatenate([first, rest]), np.concatenate([d, *more])
    order = np.lexsort((at, d))[:k]
    return at[order], d[order], len(at)


def first_distances(values: np.ndarray, query: np.ndarray, lengths: list[int], k: int, r: int, w: int, allowed=None, mode: str = "both", context=None) -> dict[int, np.ndarray]:
    """length -> true distances of the k smallest bounds, ascending: what a threshold over several chunks is made of."""
    bounds = lower_bounds(values, query, lengths, r, w, mode, context)
    return {length: np.sort(_first(values, query, length, k, r, bounds[length], _free(bounds[length], allowed, length))[1]) for length in lengths}


def _free(lb: np.ndarray, allowed, length: int) -> np.ndarray:
    mask = allowed[length] if isinstance(allowed, dict) else allowed
    return np.arange(len(lb)) if mask is None else np.flatnonzero(mask[: len(lb)])


def _first(values, query, length, k, r, lb, starts) -> tuple[np.ndarray, np.ndarray]:
    first = starts[smallest(lb[starts], k)]
    return first, dtw(query[len(query) - length :], windows(values, length)[first], r) if len(first) else np.zeros(0)


class BoundRing:
    """Bounds of the windows of a moving query against the disjoint windows of its growing series, kept from step to step.

    The query is the latest `longest` values. When it moves on, most of its windows stay: a ring holds their rows, and only
    new windows, and those within the band before them, whose envelope has got new values on its right, are refreshed. The
    envelope that a window keeps on its left is wider than it need be, so its bound stays valid. Series windows enter as
    they are completed, and those whose envelope was still open are refreshed. refreshed counts the rows of the last step.
    """

    def __init__(self, longest: int, r: int, w: int):
        if longest < w:
            raise ValueError("the longest length has to hold a window")
        self.longest, self.r, self.w = longest, r, w
        self.rows = longest - w + 1
        self.d = self.e = np.zeros((self.rows, 0))
        self.up, self.lo = np.zeros((self.rows, w)), np.zeros((self.rows, w))
        self.n, self.refreshed = 0, 0

    def step(self, values: np.ndarray) -> None:
        """Takes the series as it is now: what it was before, with new values at its end."""
        n, w, r = len(values), self.w, self.r
        start, columns = n - self.longest, n // w
        if columns > self.d.shape[1]:
            more = ((0, 0), (0, max(columns, 2 * self.d.shape[1]) - self.d.shape[1]))
            self.d, self.e = np.pad(self.d, more), np.pad(self.e, more)
        dirty = np.arange(max(start, self.n - w - r + 1) if self.n else start, n - w + 1)
        closed = max(0, (self.n - r - w) // w + 1) if self.n else 0  # columns whose envelope is final
        up, lo = envelope(values[start:], r)
        place = (dirty - start)[:, None] + np.arange(w)
        self.up[dirty % self.rows], self.lo[dirty % self.rows] = up[place], lo[place]
        first = max(0, closed * w - r)
        du, dl = envelope(values[first:], r)
        if len(dirty):
            whole_up, whole_lo = envelope(values, r) if first else (du, dl)
            self._fill(values, dirty, 0, columns, whole_up, whole_lo, 0)
        rest = np.arange(start, dirty[0] if len(dirty) else n - w + 1)
        if len(rest) and closed < columns:
            self._fill(values, rest, closed, columns, du, dl, first)
        self.n, self.refreshed = n, len(dirty)

    def _fill(self, values, at, low, high, du, dl, first) -> None:
        w, row = self.w, at % self.rows
        x = values[low * w : high * w].reshape(-1, w)
        u, v = (z[low * w - first : high * w - first].reshape(-1, w) for z in (du, dl))
        d, e = np.zeros((len(at), high - low)), np.zeros((len(at), high - low))
        for k in range(w):
            d += outside(x[None, :, k], self.up[row, k, None], self.lo[row, k, None])
            e += outside(values[at + k][:, None], u[None, :, k], v[None, :, k])
        self.d[row, low:high], self.e[row, low:high] = d, e

    def lower_bounds(self, length: int) -> np.ndarray:
        """Bounds of all starts for the latest `length` values, over the whole series windows inside each candidate."""
        starts = np.arange(max(0, self.n - length + 1))
        column = -(-starts // self.w)
        d, e = np.zeros(len(starts)), np.zeros(len(starts))
        for k in range(length // self.w):
            x = (column + k) * self.w - starts
            ok = np.flatnonzero(x + self.w <= length)
            row = (self.n - length + x[ok]) % self.rows
            d[ok] += self.d[row, column[ok] + k]
            e[ok] += self.e[row, column[ok] + k]
        return np.maximum(d, e)
