"""Small fits on bounded samples: isotonic and logistic calibration."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x, fitted value), values never falling.

    Rows with equal x are one point; every pool is represented by its mean x."""
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    weights = np.diff(np.append(first, len(x))).astype(float)
    values = np.add.reduceat(y[order].astype(float), first) / weights if len(x) else np.zeros(0)
    pools: list[list[float]] = []  # mean y, weight, mean x
    for v, w, p in zip(values, weights, xs):
        pools.append([v, w, p])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, (a[2] * a[1] + b[2] * b[1]) / w])
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
