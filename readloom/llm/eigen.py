"""Leading eigenvectors of a symmetric matrix: Householder reduction to a
tridiagonal matrix, bisection by Sturm counts, inverse iteration.

The matrix is of the vectors' dimensions, so it is small whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3  # eigenvalues this near, as a share of the norm, are made orthogonal to each other
ITERATIONS = 6


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit reflectors v of the steps: step k works on rows k + 1 and on."""
    a = np.array(a, float)
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        size = np.linalg.norm(x)
        v[0] += size if x[0] >= 0 else -size
        length = np.linalg.norm(v)
        if np.linalg.norm(x[1:]) == 0 or length == 0:
            reflectors.append(np.zeros_like(v))
            continue
        v /= length
        reflectors.append(v)
        part = a[k + 1 :, k + 1 :]
        w = part @ v
        w -= (v @ w) * v
        part -= 2 * np.outer(v, w) + 2 * np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ x) * v
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def back(vector: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the whole matrix."""
    out = vector.copy()
    for k in reversed(range(len(reflectors))):
        v = reflectors[k]
        out[k + 1 :] -= 2 * (v @ out[k + 1 :]) * v
    return out


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each x, by the signs of the pivots of T - x."""
    least = max(float(np.abs(off).max(initial=0)) ** 2, 1.0) * np.finfo(float).tiny
    count = np.zeros(len(x), np.int64)
    pivot = np.ones(len(x))
    for i in range(len(diagonal)):
        pivot = diagonal[i] - x - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection of its own interval, all at once."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    slack = 2 * EPS * max(abs(low), abs(high)) + np.finfo(float).tiny
    low, high = np.full(k, low - slack), np.full(k, high + slack)
    wanted = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return high
        more = below(diagonal, off, middle) > wanted
        high, low = np.where(more, middle, high), np.where(more, low, middle)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = right by elimination with row exchanges; pivots are at least ``least``."""
    n = len(diagonal)
    rows = np.zeros((n, 3))  # of the upper triangle: the diagonal and two columns beside it
    x = right.copy()
    own = [diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        under = [off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0]
        if abs(under[0]) > abs(own[0]):
            own, under = under, own
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(own[0]) < least:
            own[0] = least
        factor = under[0] / own[0]
        x[i + 1] -= factor * x[i]
        rows[i] = own
        own = [under[1] - factor * own[1], under[2] - factor * own[2], 0.0]
    rows[n - 1] = [own[0] if abs(own[0]) >= least else least, 0.0, 0.0]
    for i in reversed(range(n)):
        x[i] -= rows[i, 1] * x[i + 1] if i + 1 < n else 0.0
        x[i] -= rows[i, 2] * x[i + 2] if i + 2 < n else 0.0
        x[i] /= rows[i, 0]
    return x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows."""
    n, scale = len(a), float(np.abs(a).max(initial=0))
    k = min(k, n)
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(k, n)
    diagonal, off, reflectors = tridiagonal(np.asarray(a, float) / scale)
    values = leading_values(diagonal, off, k)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    random, vectors = np.random.default_rng(1), []
    for i in range(k):
        # Equal eigenvalues get shifts of their own, so that elimination differs.
        shift = values[i] - 4 * EPS * norm * sum(abs(values[j] - values[i]) <= 8 * EPS * norm for j in range(i))
        near = [vectors[j] for j in range(i) if abs(values[j] - values[i]) <= CLUSTER * norm]
        x = random.normal(size=n)
        for _ in range(ITERATIONS):
            x = solve(diagonal, off, shift, x / np.abs(x).max(), EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                for v in near:
                    x -= (v @ x) * v
            x /= np.linalg.norm(x)
        vectors.append(x)
    out = np.array([back(x, reflectors) for x in vectors])
    return values * scale, out / np.linalg.norm(out, axis=1)[:, None]
