"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law of inertia the positive pivots of LDLᵀ of ``A - sI`` count the eigenvalues above s. Bisection on
these counts isolates one eigenvalue at a time, Rayleigh quotient iteration converges to it cubically, and the counts
certify that the pair it ends at is the one that was numbered. The matrix is of d x d numbers, d the vectors' dimension.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Eigenvalues closer than this share of the matrix's norm are taken as one cluster.
CLUSTER = 1e-13
#: Most steps of Rayleigh quotient iteration; three or four are usual.
STEPS = 12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and subdiagonal of the tridiagonal matrix that Householder reflections turn ``a`` into; its shifts have the inertia of those of ``a``."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        if not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1, k] = -np.copysign(np.linalg.norm(x), x[0])
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
    return np.diag(a).copy(), np.diag(a, -1).copy()


def counter(a: np.ndarray) -> Callable[[float], int]:
    """How many eigenvalues of ``a`` are greater than a shift: positive pivots of LDLᵀ of the shifted matrix.

    For a tridiagonal matrix the pivots are one recurrence that needs no exchanges; one that vanishes counts as a tiny one.
    """
    diagonal, below = tridiagonal(a)
    squares = [0.0, *(below * below).tolist()]
    diagonal = diagonal.tolist()
    tiny = np.finfo(float).tiny + np.finfo(float).eps * float(np.abs(below).max(initial=0.0)) * np.finfo(float).eps

    def above(shift: float) -> int:
        positive, pivot = 0, 1.0
        for d, s in zip(diagonal, squares, strict=True):
            pivot = d - shift - s / pivot
            if abs(pivot) < tiny:
                pivot = tiny
            positive += pivot > 0
        return positive

    return above


def _solve(a: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    m = a - shift * np.eye(len(a))
    try:
        return np.linalg.solve(m, b)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(m + np.finfo(float).eps * float(np.abs(a).max()) * np.eye(len(a)), b)


def _orthogonal(block: np.ndarray, found: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``block``, less their parts along the rows of ``found``."""
    for _ in range(2):
        block = np.linalg.qr(block - found.T @ (found @ block))[0]
    return block


def _quotients(a: np.ndarray, v: np.ndarray, found: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Value, unit vector and residual where Rayleigh quotient iteration from ``v`` stops getting better."""
    best = None
    for _ in range(STEPS):
        value = float(v @ a @ v)
        rest = float(np.linalg.norm(a @ v - value * v))
        if best is not None and rest >= best[2]:
            break
        best = value, v, rest
        if rest == 0:
            break
        v = _orthogonal(_solve(a, value, v)[:, None], found)[:, 0]
    return best


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest eigenvalues of the symmetric ``a``, falling, and unit eigenvectors as rows.

    A bracket that counts show to hold one eigenvalue gives it to inverse iteration and Rayleigh quotients; if these end
    elsewhere, the bracket is halved further. Eigenvalues that counts can't tell apart, equal ones up to rounding, give an
    orthonormal basis of their common space. Of each vector the entry of greatest size is positive.
    """
    a = (a + a.T) / 2
    n = len(a)
    most = min(most, n)
    scale = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if not scale:
        return np.zeros(most), np.eye(n)[:most]
    above, slack, rng = counter(a), CLUSTER * scale, np.random.default_rng(0)
    values: list[float] = []
    vectors = np.zeros((0, n))
    hi = scale + slack
    while (k := len(values)) < most:
        lo, fresh = -scale - slack, []
        while not fresh:  # k eigenvalues are above hi, more are above lo
            together = above(lo) - k
            if hi - lo <= 2 * slack:
                block = rng.standard_normal((n, together))
                for _ in range(3):
                    block = _orthogonal(_solve(a, (lo + hi) / 2, block), vectors)
                value, turn = np.linalg.eigh(block.T @ a @ block)
                fresh = [(float(value[j]), block @ turn[:, j]) for j in reversed(range(together))]
            elif together == 1:
                start = rng.standard_normal((n, 1))
                for _ in range(2):
                    start = _orthogonal(_solve(a, (lo + hi) / 2, start), vectors)
                value, vector, rest = _quotients(a, start[:, 0], vectors)
                if rest <= slack and lo < value - rest and value + rest < hi:
                    fresh = [(value, vector)]
            if not fresh:
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if above(mid) > k else (lo, mid)
        hi = lo
        values += [value for value, _ in fresh]
        vectors = np.vstack([vectors, *(vector for _, vector in fresh)])
    vectors = vectors[:most]
    return np.array(values[:most]), vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1))
