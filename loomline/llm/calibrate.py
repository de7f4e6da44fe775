"""Logistic calibration of a few features, by Newton steps with a small ridge."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """P(label 1) of standardised features. Without both labels it is the smoothed rate of label 1, or 0.5 without any row.

    rate: of label 1 in what is to be scored, where the rows were drawn by label; the intercept is corrected from the
    rows' own rate to it.
    """

    def __init__(self, features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rate: float | None = None) -> None:
        self.rate = rate
        x, y = np.asarray(features, float), np.asarray(labels, float)
        width = x.shape[1] if x.ndim == 2 else 0
        self.mean = x.mean(0) if len(y) else np.zeros(width)
        self.scale = np.maximum(x.std(0), 1e-9) if len(y) else np.ones(width)
        self.weights = np.zeros(width + 1)
        drawn = (y.sum() + 0.5) / (len(y) + 1)
        self.weights[0] = np.log(drawn / (1 - drawn))
        if 0 < y.sum() < len(y):
            a = self._design(x)
            penalty = np.full(width + 1, ridge)
            penalty[0] = 1e-6
            for _ in range(100):
                p = sigmoid(a @ self.weights)
                step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * self.weights)
                self.weights += np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-8:
                    break
        if rate is not None and 0 < y.sum() < len(y):
            self.weights[0] += np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(x), 1)), z], axis=1)

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self._design(np.asarray(features, float)) @ self.weights)

    def base(self) -> float:
        """The score where nothing is known of the features: the rate, where it is given, else that at mean features."""
        return self.rate if self.rate is not None else float(sigmoid(self.weights[:1])[0])
