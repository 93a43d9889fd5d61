"""Sparse rows over hashed features, in numpy: row r has the columns col[start[r]:start[r + 1]] with values val."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    start: np.ndarray
    col: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, cols: list[np.ndarray], vals: list[np.ndarray] | None = None) -> Rows:
        n = np.array([len(c) for c in cols], dtype=np.int64)
        col = np.concatenate(cols).astype(np.int64) if len(cols) else np.zeros(0, np.int64)
        val = np.concatenate(vals).astype(np.float64) if vals else np.ones(len(col))
        return cls(np.concatenate([[0], np.cumsum(n)]), col, val)

    def __len__(self) -> int:
        return len(self.start) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def dot(self, w: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=w[self.col] * self.val, minlength=len(self))

    def spread(self, g: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
        """Sum over rows of g[row] * row."""
        return np.bincount(self.col, weights=g[owner] * self.val, minlength=size)


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def logistic(rows: Rows, target: np.ndarray, size: int, steps: int = 300, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that fit targets in [0, 1]."""
    owner, w, opt = rows.owner(), np.zeros(size + 1), Adam(size + 1, rate)
    for _ in range(steps):
        g = (sigmoid(rows.dot(w[:size], owner) + w[size]) - target) / max(1, len(rows))
        w = opt.step(w, np.append(rows.spread(g, owner, size) + l2 * w[:size], g.sum()))
    return w[:size], float(w[size])
