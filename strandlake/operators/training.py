"""Training of small networks by gradients that tasks sum, and balancing of several losses."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.learned import network_gradient


def combine_losses(losses: dict[str, float], weights: dict[str, float] | None = None) -> float:
    """Sum of named losses, by weights where given."""
    return float(sum(v * (weights or {}).get(k, 1.0) for k, v in losses.items()))


def balance_weights(weights: dict[str, float], norms: dict[str, float], losses: dict[str, float], first: dict[str, float], alpha: float = 1.5, rate: float = 0.025) -> dict[str, float]:
    """One GradNorm step: weights move so that gradient norms follow the losses' relative rates; they keep their sum."""
    mean = sum(weights[k] * norms[k] for k in weights) / len(weights)
    share = {k: losses[k] / max(first[k], 1e-12) for k in weights}
    middle = sum(share.values()) / len(share)
    moved = {k: max(weights[k] - rate * np.sign(weights[k] * norms[k] - mean * (share[k] / middle) ** alpha) * norms[k], 1e-3) for k in weights}
    total = sum(moved.values())
    return {k: v * len(moved) / total for k, v in moved.items()}


def cross_entropy(rows: DataFrame, logits: str, label: str) -> DataFrame:
    """One row: mean of log-sum-exp of the logits less the logit of the label."""
    from strandlake.functions.numeric import array_logsumexp

    return rows.agg(F.avg(array_logsumexp(logits) - F.element_at(F.col(logits), F.col(label).cast("int") + 1)).alias("loss"))


@dataclass
class Trainer:
    """Full-batch Adam over the rows of a table: every epoch is one pass whose tasks hand on one summed gradient each.

    clip bounds the gradient's norm; `history` holds the mean loss before each epoch.
    """

    layers: list
    rate: float = 0.01
    clip: float = 1.0
    history: list[float] = field(default_factory=list)

    def _pass(self, rows: DataFrame, vec: str, label: str) -> tuple[float, int, list]:
        layers = self.layers

        def run(batches):
            total, n, sums = 0.0, 0, [np.zeros(w.size + b.size) for w, b in layers]
            for batch in batches:
                if batch.num_rows:
                    loss, grads = network_gradient(np.array(batch.column(0).to_pylist(), np.float64), np.array(batch.column(1).to_pylist(), np.int64), layers)
                    total, n = total + loss, n + batch.num_rows
                    for s, (w, b) in zip(sums, grads):
                        s += np.concatenate([w.ravel(), b])
            rows = [(k, float(total) if k == 0 else 0.0, n if k == 0 else 0, s.tolist()) for k, s in enumerate(sums)]
            k, loss, count, g = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(loss), pa.array(count, pa.int64()), pa.array(g, pa.list_(pa.float64()))], names=["k", "loss", "n", "g"])

        parts = rows.select(vec, label).mapInArrow(run, "k int, loss double, n long, g array<double>")
        long = parts.select("k", F.posexplode("g").alias("i", "g")).groupBy("k", "i").agg(F.sum("g").alias("g")).collect()
        loss, n = parts.agg(F.sum("loss"), F.sum("n")).first()
        flat = [np.zeros(w.size + b.size) for w, b in layers]
        for r in long:
            flat[r["k"]][r["i"]] = r["g"]
        return float(loss or 0.0), int(n or 0), flat

    def fit(self, rows: DataFrame, vec: str = "vec", label: str = "label", epochs: int = 10) -> Trainer:
        first, second = [np.zeros(w.size + b.size) for w, b in self.layers], [np.zeros(w.size + b.size) for w, b in self.layers]
        for t in range(1, epochs + 1):
            loss, n, grads = self._pass(rows, vec, label)
            if not n:
                return self
            self.history.append(loss / n)
            grads = [g / n for g in grads]
            norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
            grads = [g * min(1.0, self.clip / max(norm, 1e-12)) for g in grads]
            layers = []
            for k, (w, b) in enumerate(self.layers):
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                step = self.rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                layers.append((w - step[: w.size].reshape(w.shape), b - step[w.size :]))
            self.layers = layers
        return self


def ridge_fit(rows: DataFrame, features: list[str], target: str, strength: float = 1e-3) -> np.ndarray:
    """Weights, the constant last, of closed-form ridge regression: one aggregate over the products of the columns."""
    cols = [*[F.col(f).cast("double") for f in features], F.lit(1.0), F.col(target).cast("double")]
    n = len(cols)
    sums = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = sums[f"s{i}_{j}"] or 0.0
    return np.linalg.solve(m[:-1, :-1] + strength * np.eye(n - 1), m[:-1, -1])
