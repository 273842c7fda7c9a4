"""Sparse multinomial logistic regression by follow-the-regularised-leader, with elastic-net penalties."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, width: int, l1: float, l2: float, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, seed: int = 3,
    times: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """rows: (feature numbers, values) each. wanted: a distribution over the classes for each row. times: how often
    an epoch shows each row.
    Returns weights (width, classes), exactly zero where the l1 penalty holds them there, and the intercepts."""
    classes = wanted.shape[1]
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
    penalty = np.full((width + 1, 1), l1)
    penalty[width] = 0.0  # the intercept

    def weights(at):
        zz, p = z[at], penalty[at]
        return np.where(np.abs(zz) > p, -(zz - np.sign(zz) * p) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order, shown = np.random.default_rng(seed), np.repeat(np.arange(len(rows)), 1 if times is None else times)
    for _ in range(epochs):
        for i in order.permutation(shown):
            at = np.append(rows[i][0], width)
            x = np.append(rows[i][1], 1.0)
            w = weights(at)
            g = np.outer(x, softmax(x @ w) - wanted[i])
            had = n[at]
            now = had + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(had)) / alpha * w
            n[at] = now
    w = weights(np.arange(width + 1))
    return w[:width], w[width]


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits at which the truth is likeliest, by golden section on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
