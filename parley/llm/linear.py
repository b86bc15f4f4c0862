"""Small linear learners on sparse rows, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # feature numbers (distinct), values


def linear_svm(rows: list[Row], sign: np.ndarray, n_features: int, c: float = 10.0, sweeps: int = 12,
               seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss, L2),
    by dual coordinate descent; the bias is the weight of a constant feature."""
    w, bias = np.zeros(n_features, np.float64), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(sweeps):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            y = sign[i]
            gradient = y * (float(w[at] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def cumulative_link(x: np.ndarray, grade: np.ndarray, n_grades: int, l2: float = 1e-4, steps: int = 1500,
                    rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative weights and ordered thresholds of an ordinal regression
    P(grade >= k) = sigmoid(x.w - threshold_k), the weights shared by all
    thresholds, by projected Adam steps on the penalised logistic loss."""
    n, d = x.shape
    w = np.zeros(d)
    cut = np.linspace(1.0, 3.0, n_grades - 1)
    m, v = np.zeros(d + len(cut)), np.zeros(d + len(cut))
    above = np.stack([grade >= k for k in range(1, n_grades)], axis=1).astype(float)
    for t in range(1, steps + 1):
        p = sigmoid((x @ w)[:, None] - cut[None, :])
        err = (p - above) / n  # each threshold's logistic loss
        g = np.concatenate([x.T @ err.sum(axis=1) + l2 * w, -err.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w = np.maximum(w - move[:d], 0.0)
        cut = np.sort(cut - move[d:])
    return w, cut
