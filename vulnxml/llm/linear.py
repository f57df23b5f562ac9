"""Logistic regression and Platt calibration on a bounded, dense sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 8.0) -> tuple[np.ndarray, float]:
    """Class-balanced weights and bias by accelerated gradient steps; rows of
    ``x`` have unit length."""
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), 0.0
    for k in range(steps):
        g = (share * (sigmoid(x @ vw + vb) - y)).astype(np.float32)
        nw, nb = vw - rate * (x.T @ g + l2 * vw), vb - rate * float(g.sum())
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def fit_platt(score: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is a probability: Newton steps on
    smoothed targets, a ridge keeps a separable sample finite."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        g = np.array([((p - t) * score).sum() + 1e-3 * a, (p - t).sum() + 1e-3 * b])
        h = p * (1 - p) + 1e-9
        m = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        norm = float(np.abs(step).max())
        step = step / max(1.0, norm / 5)
        a, b = a - step[0], b - step[1]
        if norm < 1e-8:
            break
    return float(a), float(b)
