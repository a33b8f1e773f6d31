"""Inference of a bidirectional recurrent classifier in numpy, batch by batch on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


@dataclass(frozen=True)
class Cell:
    """Weights of one gated recurrent layer: of inputs ``w``, of the state ``u`` and ``b``, the update, reset and candidate parts side by side."""

    w: np.ndarray
    u: np.ndarray
    b: np.ndarray

    @property
    def size(self) -> int:
        return self.u.shape[0]

    def run(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """States at all times for ``x`` of samples, times and values; where the mask is false the state stays."""
        n, h = self.size, np.zeros((len(x), self.size))
        out = np.zeros((len(x), x.shape[1], n))
        from_input = x @ self.w + self.b
        for t in range(x.shape[1]):
            i = from_input[:, t]
            z = _gate(i[:, :n] + h @ self.u[:, :n])
            r = _gate(i[:, n : 2 * n] + h @ self.u[:, n : 2 * n])
            new = np.tanh(i[:, 2 * n :] + (r * h) @ self.u[:, 2 * n :])
            h = np.where(mask[:, t : t + 1], z * h + (1 - z) * new, h)
            out[:, t] = h
        return out


@dataclass(frozen=True)
class Classifier:
    """Layers of a forward and a backward cell each, and a dense output; times of zeros alone are masked."""

    layers: list[tuple[Cell, Cell]]
    w: np.ndarray
    b: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        mask = np.any(x != 0, axis=2)
        for k, (ahead, back) in enumerate(self.layers):
            f = ahead.run(x, mask)
            r = back.run(x[:, ::-1], mask[:, ::-1])
            last = k == len(self.layers) - 1
            x = np.concatenate([f[:, -1], r[:, -1]], axis=1) if last else np.concatenate([f, r[:, ::-1]], axis=2)
        return 1 / (1 + np.exp(-(x @ self.w + self.b)))

    @classmethod
    def seeded(cls, inputs: int, size: int, layers: int = 2, seed: int = 1) -> Classifier:
        """Random weights, for tests and as a start."""
        rng = np.random.default_rng(seed)
        made, width = [], inputs
        for _ in range(layers):
            made.append(tuple(Cell(rng.normal(0, 0.3, (width, 3 * size)), rng.normal(0, 0.3, (size, 3 * size)), np.zeros(3 * size)) for _ in range(2)))
            width = 2 * size
        return cls(made, rng.normal(0, 0.3, 2 * size), 0.0)


def predict(samples: DataFrame, model: Classifier, key: str = "sample_id") -> DataFrame:
    """``(key, p)`` for ``samples(key, x)``, ``x`` being arrays of equal length over time of arrays of values."""
    shared = samples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), dtype=float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.predict(x))], [key, "p"])

    return samples.select(key, "x").mapInArrow(run, f"{key} long, p double")
