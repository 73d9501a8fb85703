"""Logistic regression on a few columns, for turning raw scores into probabilities."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the bias last) by Newton's method. One class only: its share, slightly drawn to one half, whatever x is."""
    x = np.asarray(x, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge * len(y) ** 0.5), 1e-6)

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return np.logaddexp(0, m).sum() - y @ m + 0.5 * penalty @ (w * w)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), slope)
        t, now = 1.0, loss(w)
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return mean, scale, w


def probability(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip((np.asarray(x, float).reshape(-1, len(mean)) - mean) / scale @ w[:-1] + w[-1], -30, 30)))
