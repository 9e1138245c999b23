"""Logistic calibration of a few features."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Ridge logistic regression by Newton steps. With one class only, the score is the share of ones."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 40):
        self.mean = features.mean(axis=0) if len(features) else np.zeros(features.shape[1])
        self.scale = features.std(axis=0) + 1e-9 if len(features) else np.ones(features.shape[1])
        self.weights = np.zeros(features.shape[1] + 1)
        ones = float(labels.mean()) if len(labels) else 0.5
        self.constant = ones if not len(labels) or ones in (0.0, 1.0) else None
        if self.constant is None:
            x = self._design(features)
            penalty = ridge * np.eye(x.shape[1])
            for _ in range(steps):
                p = self._sigmoid(x @ self.weights)
                hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
                step = np.linalg.solve(hessian, x.T @ (labels - p) - ridge * self.weights)
                self.weights += np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-8:
                    break

    def _design(self, features: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(features), 1)), (features - self.mean) / self.scale], axis=1)

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return self._sigmoid(self._design(features) @ self.weights)
