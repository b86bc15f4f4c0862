"""Leading eigenvectors of a symmetric matrix by QDWH spectral divide and
conquer.

The polar factor of a shifted matrix is its matrix sign; (sign + I) / 2 is the
orthogonal projector on the invariant subspace of the eigenvalues above the
shift.  A basis of that subspace and of its complement splits the matrix in
two, which are split on until each part is one component.  The polar factor
comes from the QR-based dynamically weighted Halley iteration, which needs at
most six or seven steps at any condition number.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def weights(low: float) -> tuple[float, float, float]:
    """Halley weights for singular values in [low, 1]."""
    square = low * low
    d = np.cbrt(4 * (1 - square) / (square * square))
    root = np.sqrt(1 + d)
    a = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
    b = (a - 1) ** 2 / 4
    return a, b, a + b - 1


def polar_factor(a: np.ndarray, least: float = 1e-14) -> np.ndarray | None:
    """Symmetric orthogonal polar factor of the symmetric ``a``, or None if
    ``a`` is singular to ``least`` (no sign is defined)."""
    size = np.linalg.norm(a)
    if not size:
        return None
    x, eye = a / size, np.eye(len(a))
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # not above the smallest singular value
    except np.linalg.LinAlgError:
        return None
    if not low > least:
        return None
    low = min(low, 1.0)
    for _ in range(40):
        wa, wb, wc = weights(low)
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            step = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:len(a)] @ q[len(a):].T)
        else:  # well conditioned: by Cholesky
            half = np.linalg.inv(np.linalg.cholesky(eye + wc * (x.T @ x)))
            step = (wb / wc) * x + (wa - wb / wc) * ((x @ half.T) @ half)
        step = (step + step.T) / 2
        moved, x = np.linalg.norm(step - x), step
        low = min(low * (wa + wb * low * low) / (1 + wc * low * low), 1.0)
        if moved <= (4 * EPS) ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def shifts(a: np.ndarray):
    """Where to split: at the median of the diagonal, at its mean (which lies
    between the extreme eigenvalues), then close to the mean."""
    d = np.diag(a)
    mean = d.mean()
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / len(a)
    yield np.median(d)
    yield mean
    for k in range(1, 9):
        yield mean + spread * k / 40
        yield mean - spread * k / 40


def halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of two invariant subspaces of ``a``, that of the
    larger eigenvalues first."""
    n, best = len(a), None
    draw = np.random.default_rng(5).standard_normal((n, n))
    for shift in shifts(a):
        sign = polar_factor(a - shift * np.eye(n))
        if sign is None:
            continue
        projector = (sign + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = np.linalg.qr(projector @ draw[:, :k], mode="complete")[0]
        basis = np.linalg.qr(projector @ basis[:, :k], mode="complete")[0]
        upper, lower = basis[:, :k], basis[:, k:]
        off = np.linalg.norm(lower.T @ a @ upper)
        if best is None or off < best[0]:
            best = off, upper, lower
        if off <= 4 * n * EPS * scale:
            break
    if best is None:
        raise ArithmeticError("no shift splits the matrix")
    return best[1], best[2]


def leading_components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of the symmetric ``a``, falling, and
    their unit eigenvectors as columns (all of them if there are fewer)."""
    a = (np.asarray(a, float) + np.asarray(a, float).T) / 2
    scale = np.linalg.norm(a)
    values, vectors = [], []
    todo = [(a, np.eye(len(a)))] if len(a) else []
    while todo and len(values) < count:  # the part of the largest eigenvalues is on top
        part, basis = todo.pop()
        off = np.linalg.norm(part - np.diag(np.diag(part)))
        if len(part) == 1 or off <= EPS * scale:
            order = np.argsort(-np.diag(part), kind="stable")
            values += np.diag(part)[order].tolist()
            vectors += list(basis.T[order])
            continue
        upper, lower = halves(part, scale)
        for side in (lower, upper):
            inner = side.T @ part @ side
            todo.append(((inner + inner.T) / 2, basis @ side))
    order = np.argsort(-np.array(values), kind="stable")[:count]
    vectors = np.array(vectors).reshape(len(values), len(a))[order].T
    vectors = np.ascontiguousarray(vectors / np.linalg.norm(vectors, axis=0))
    return np.einsum("ij,ik,kj->j", vectors, a, vectors), vectors
