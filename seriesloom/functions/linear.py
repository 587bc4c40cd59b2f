"""Small matrix helpers."""

from __future__ import annotations

import numpy as np


def lower_vector(m: np.ndarray) -> np.ndarray:
    """The lower triangle, row by row."""
    return m[np.tril_indices(len(m))]


def upper_vector(m: np.ndarray) -> np.ndarray:
    """The upper triangle, column by column."""
    return lower_vector(m.T)


def lower_matrix(v: np.ndarray) -> np.ndarray:
    n = int((np.sqrt(8 * len(v) + 1) - 1) / 2)
    out = np.zeros((n, n))
    out[np.tril_indices(n)] = v
    return out


def upper_matrix(v: np.ndarray) -> np.ndarray:
    return lower_matrix(v).T


def condition(m: np.ndarray) -> float:
    """Ratio of the largest to the smallest singular value."""
    s = np.linalg.svd(m, compute_uv=False)
    return float(s[0] / s[-1])


def permutation(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n)


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns with mean 0 and sample deviation 1, the means and the deviations."""
    mean, dev = x.mean(0), x.std(0, ddof=1)
    return (x - mean) / dev, mean, dev


def restore(z: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    return z * dev + mean


def sequence(first: int, last: int) -> np.ndarray:
    """The whole numbers from first to last, both included."""
    return np.arange(first, last + 1)


def sign(x) -> np.ndarray:
    """-1, 0 or 1 for each number."""
    return np.sign(x)


def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smaller of each two numbers."""
    return np.minimum(a, b)


def join_columns(*parts: np.ndarray) -> np.ndarray:
    """Matrices and vectors next to each other; a vector is one column."""
    return np.column_stack(parts)
