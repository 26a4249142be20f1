"""Small dense logistic regression, fitted on the driver over bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, l2: float = 1.0, rounds: int = 50, weight: np.ndarray | None = None) -> Logistic:
    """Newton steps on standardised columns, drawn towards ``prior`` (standardised weights, default 0).

    Without rows, or with one class only, the prior weights and a smoothed base rate are the model.
    """
    n, d = x.shape
    prior = np.zeros(d) if prior is None else prior
    mean = x.mean(0) if n else np.zeros(d)
    scale = x.std(0) if n else np.ones(d)
    scale = np.where(scale > 1e-9, scale, 1.0)
    weight = np.ones(n) if weight is None else weight
    positive, total = float((weight * y).sum()), float(weight.sum())
    start = float(np.log((positive + 0.5) / (total - positive + 0.5)))
    if n == 0 or positive in (0.0, total):
        return Logistic(mean, scale, prior.copy(), start)
    z = np.hstack([(x - mean) / scale, np.ones((n, 1))])
    w, target = np.append(prior, start), np.append(prior, 0.0)
    ridge = np.append(np.full(d, l2), 1e-3)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) + ridge * (w - target)
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def blank(model: Logistic) -> Logistic:
    """The same scales, nothing learned."""
    return Logistic(model.mean, model.scale, np.zeros_like(model.weights), 0.0)


def newton_sums(model: Logistic, x: np.ndarray, y: np.ndarray, weight: float) -> np.ndarray:
    """What rows add to a Newton step from ``model``: gradient, then the rows of the Hessian."""
    z = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    p = model.probability(x)
    hessian = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
    return np.concatenate([weight * (z.T @ (p - y)), hessian.reshape(-1)])


def newton_step(model: Logistic, sums: np.ndarray, l2: float = 1.0) -> Logistic:
    """The model after a step with these sums over all its rows; weights are drawn towards 0."""
    d = len(model.weights) + 1
    w, ridge = np.append(model.weights, model.bias), np.append(np.full(d - 1, l2), 1e-3)
    step = np.linalg.solve(sums[d:].reshape(d, d) + np.diag(ridge), sums[:d] + ridge * w)
    w = w - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
    return Logistic(model.mean, model.scale, w[:-1], float(w[-1]))
