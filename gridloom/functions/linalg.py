"""Small dense kernels: principal components from moments, Varimax, sparse components, alignment.

All start from a Gram or covariance matrix, so the data behind it is scanned once, by Spark.
"""

from __future__ import annotations

from itertools import permutations
from math import erfc, floor, log, sqrt
from statistics import NormalDist

import numpy as np


def positive(columns: np.ndarray) -> np.ndarray:
    """Signs (+1 or -1 a column) that make each column's largest entry positive."""
    at = np.abs(columns).argmax(0)
    return np.where(columns[at, np.arange(columns.shape[1])] < 0, -1.0, 1.0)


def from_moments(n: float, s: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (ddof 1)."""
    return s / n, (g - np.outer(s, s) / n) / (n - 1)


def to_correlation(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(cov))
    if not (d > 0).all():
        raise ValueError("a column without variance")
    return cov / np.outer(d, d)


def principal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and eigenvectors with the sign rule; tiny negative values are 0."""
    w, v = np.linalg.eigh((matrix + matrix.T) / 2)
    w, v = w[::-1], v[:, ::-1]
    if w.min() < -1e-12 * max(1.0, w.max()):
        raise ValueError(f"negative eigenvalue {w.min()}")
    return np.maximum(w, 0.0), v * positive(v)


def residual_covariance(cov: np.ndarray, x: list[int], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Betas (y by x) and the covariance of y given x, from the joint covariance."""
    b = np.linalg.solve(cov[np.ix_(x, x)], cov[np.ix_(x, y)]).T
    return b, cov[np.ix_(y, y)] - b @ cov[np.ix_(x, y)]


def varimax(loadings: np.ndarray, limit: int = 1000, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, int]:
    """Rotated loadings, the orthogonal rotation, and rounds until the criterion's singular values settle."""
    p, k = loadings.shape
    turn, last = np.eye(k), None
    for round_no in range(1, limit + 1):
        now = loadings @ turn
        u, s, vt = np.linalg.svd(loadings.T @ (now * (now**2 - (now**2).mean(0))), full_matrices=False)
        turn, total = u @ vt, s.sum()
        if last is not None and abs(total - last) <= tolerance * max(1.0, abs(last)):
            break
        last = total
    now = loadings @ turn
    signs = positive(now)
    return now * signs, turn * signs, round_no


def shrink(x: np.ndarray | float, by: float):
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def sparse_components(gram: np.ndarray, k: int, l1: float, l2: float, limit: int = 1000, tolerance: float = 1e-7) -> dict:
    """Elastic-net components by alternating coordinate descent and a polar step, from the Gram alone."""
    _, v = principal(gram)
    a, b = v[:, :k].copy(), v[:, :k].copy()
    scale = np.diag(gram)
    for round_no in range(1, limit + 1):
        before = b.copy()
        for c in range(k):
            pull = gram @ a[:, c]
            for _ in range(limit):
                old = b[:, c].copy()
                for i in range(len(gram)):
                    b[i, c] = shrink(pull[i] - gram[i] @ b[:, c] + scale[i] * b[i, c], l1) / (scale[i] + l2)
                if np.abs(b[:, c] - old).max() <= 1e-9:
                    break
        u, _, wt = np.linalg.svd(gram @ b, full_matrices=False)
        a = u @ wt
        if np.abs(b - before).max() <= tolerance:
            break
    norms = np.linalg.norm(b, axis=0)
    if (norms <= 1e-8).any():
        raise ValueError("an empty sparse component; the penalty is too large")
    w = b / norms * positive(b)
    # Least squares of the data on the scores explains tr(G W (W'GW)^-1 W'G) of tr(G).
    gw = gram @ w
    explained = np.trace(gw @ np.linalg.pinv(w.T @ gw) @ gw.T) / np.trace(gram)
    return {"weights": w, "nonzero": int((np.abs(w) > 1e-8).sum()), "explained_pct": 100 * float(explained), "rounds": round_no}


def aligned(reference: np.ndarray, estimate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order, signs and absolute cosines that match estimate's columns to reference's; best of all permutations (few columns)."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=0), 1e-300)
    c = unit(reference).T @ unit(estimate)
    k = c.shape[0]
    order = np.array(max(permutations(range(k)), key=lambda o: sum(abs(c[i, j]) for i, j in enumerate(o))))
    picked = c[np.arange(k), order]
    return order, np.where(picked < 0, -1.0, 1.0), np.abs(picked)


def jaccard(a: np.ndarray, b: np.ndarray, empty: float = 1.0) -> float:
    """Overlap of two supports; `empty` where both are."""
    union = np.logical_or(a, b).sum()
    return float(np.logical_and(a, b).sum() / union) if union else empty


def local_threshold(n: int, alpha: float = 0.05, gamma_0: float = 0.03) -> tuple[float, int]:
    """What counts as a small loading among n, and how many are more than chance: (h, critical count)."""
    h = 1 / log(n)
    p = 2 * NormalDist().cdf(h) - 1
    return h, floor((gamma_0 + p + NormalDist().inv_cdf(1 - alpha / 2) * sqrt(p * (1 - p) / n)) * n)


def two_sided(z: float) -> float:
    """P-value of a normal statistic; erfc doesn't underflow where 1 - cdf does."""
    return erfc(abs(z) / sqrt(2))
