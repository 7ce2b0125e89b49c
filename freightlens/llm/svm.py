"""Linear support vector machines by dual coordinate descent, on rows of few non-zero columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from freightlens.llm.common import taken


@dataclass(frozen=True)
class Rows:
    """Row i has ``values[offsets[i]:offsets[i + 1]]`` in these ``columns``, each at most once."""

    offsets: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def pick(self, chosen: np.ndarray) -> Rows:
        """The rows that a mask or a list of places chooses."""
        rows = np.arange(len(self))[chosen]
        offsets, columns = taken(self.offsets, self.columns, rows)
        return Rows(offsets, columns, taken(self.offsets, self.values, rows)[1], self.width)

    def totals(self, per_cell: np.ndarray) -> np.ndarray:
        """Sums over each row of numbers that belong to its cells."""
        row = np.repeat(np.arange(len(self)), np.diff(self.offsets))
        return np.bincount(row, weights=per_cell, minlength=len(self))


def train(x: Rows, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of the squared-hinge SVM for labels -1 and 1."""
    y = y.astype(np.float32)
    diagonal = x.totals(x.values**2) + 1 + 0.5 / c
    alpha, w, bias = np.zeros(len(x), np.float32), np.zeros(x.width, np.float32), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            cells = slice(x.offsets[i], x.offsets[i + 1])
            at, values = x.columns[cells], x.values[cells]
            gradient = y[i] * (values @ w[at] + bias) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w[at] += (new - alpha[i]) * y[i] * values
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return np.append(w, np.float32(bias))
