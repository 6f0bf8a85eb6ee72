"""Small logistic models fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Logistic:
    """L2-regularised logistic regression on standardised columns, by Newton steps."""

    def __init__(self, ridge: float = 1.0, steps: int = 25):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.where((s := x.std(axis=0) if len(x) else self.mean) > 1e-9, s, 1.0)
        self.coef = np.zeros(x.shape[1] + 1)
        return self._newton(x, y, weight)

    def again(self, x: np.ndarray, y: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> Logistic:
        """A model like this one (same standardisation), refitted to the rows and a quadratic loss given around its coefficients."""
        new = Logistic(self.ridge, self.steps)
        new.mean, new.scale, new.coef = self.mean, self.scale, self.coef.copy()
        return new._newton(x, y, np.ones(len(y)), (self.coef, gradient, curvature))

    def _newton(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, beside: tuple | None = None) -> Logistic:
        z = self._columns(x)
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-3  # the intercept is nearly free
        for _ in range(self.steps):
            p = sigmoid(z @ self.coef)
            grad = z.T @ (weight * (p - y)) + penalty * self.coef
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            if beside is not None:
                around, gradient, curvature = beside
                grad = grad + gradient + curvature @ (self.coef - around)
                hess = hess + curvature
            step = np.linalg.solve(hess, grad)
            self.coef -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._columns(x) @ self.coef
