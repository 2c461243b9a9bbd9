"""Dense networks of any shape, fitted by gradients that Spark sums over partitions.

* ``reconstruction``: the bottleneck network of the anomaly model (targets are the inputs, mean squared error);
* ``binary``: the failure classifier, cross entropy with a weight for every row, so no row is repeated for class balance;
* ``huber``: the days regressor, quadratic up to an error of 1 and linear beyond.

Rows become blocks of numbers once, written in the shared folder and persisted. Every step is one job: each task adds
up loss and gradient of its blocks of the mini-batch, partial sums are added in a second stage where there are many
tasks, and one vector as long as the network's weights reaches the driver from each of at most ``FAN_IN`` tasks. The driver takes
an Adam step. The loss on the validation rows (a share by hash) rides on the first job of the next epoch; training stops
when it has not improved for ``patience`` epochs, and the best weights are returned. ``models.dense_forward`` scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from .cache import keep

BLOCK_ROWS = 2048
FAN_IN = 64
_BLOCK = "part long, held boolean, n long, x binary, y binary, w binary"
_SUM = "loss double, weight double, held_loss double, held_weight double, gradient binary"


@dataclass(frozen=True)
class Shape:
    sizes: tuple              # inputs, hidden layers, outputs
    loss: str                 # binary, huber or reconstruction
    hidden: str = "relu"

    @property
    def activations(self) -> list[str]:
        return [self.hidden] * (len(self.sizes) - 2) + ["sigmoid" if self.loss == "binary" else "identity"]

    def start(self, seed: int) -> np.ndarray:
        """Random weights scaled by the width of the layer before, zero biases."""
        rng = np.random.default_rng(seed)
        parts = []
        for n_in, n_out in zip(self.sizes, self.sizes[1:]):
            parts += [rng.normal(0.0, np.sqrt(2.0 / n_in), n_in * n_out), np.zeros(n_out)]
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for n_in, n_out in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at:at + n_in * n_out].reshape(n_in, n_out), flat[at + n_in * n_out:at + (n_in + 1) * n_out]))
            at += (n_in + 1) * n_out
        return out


def _through(shape: Shape, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The inputs, the outputs of each hidden layer, and the last layer's sums."""
    layers, seen = shape.layers(flat), [x]
    for k, (weights, bias) in enumerate(layers):
        z = seen[-1] @ weights + bias
        if k < len(layers) - 1:
            z = np.maximum(z, 0.0) if shape.hidden == "relu" else np.tanh(z)
        seen.append(z)
    return seen


def _losses(shape: Shape, out: np.ndarray, y: np.ndarray) -> np.ndarray:
    if shape.loss == "binary":
        return (np.logaddexp(0.0, out) - y * out)[:, 0]
    error = out - y
    if shape.loss == "huber":
        return np.where(np.abs(error) <= 1.0, 0.5 * error ** 2, np.abs(error) - 0.5)[:, 0]
    return (error ** 2).mean(axis=1)


def row_losses(shape: Shape, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The loss of every row."""
    return _losses(shape, _through(shape, flat, x)[-1], y)


def loss_and_gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray,
                      gradient: bool = True) -> tuple[float, np.ndarray | None]:
    """Weighted sum of the rows' losses, and its gradient by all weights as one vector."""
    seen, layers = _through(shape, flat, x), shape.layers(flat)
    out = seen[-1]
    total = float(_losses(shape, out, y) @ w)
    if not gradient:
        return total, None
    delta = {"binary": lambda: 1.0 / (1.0 + np.exp(-out)) - y, "huber": lambda: np.clip(out - y, -1.0, 1.0),
             "reconstruction": lambda: 2.0 * (out - y) / shape.sizes[-1]}[shape.loss]() * w[:, None]
    parts = []
    for k in range(len(layers) - 1, -1, -1):
        parts = [(seen[k].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if k:
            delta = delta @ layers[k][0].T
            delta = delta * (seen[k] > 0.0 if shape.hidden == "relu" else 1.0 - seen[k] ** 2)
    return total, np.concatenate(parts)


def to_blocks(df: DataFrame, x_cols, y_cols, weight: Column | None = None, held_share: float = 0.1) -> DataFrame:
    """Rows without a missing number as blocks of up to ``BLOCK_ROWS`` rows; a share by hash of the row is held out."""
    x_cols, y_cols = list(x_cols), list(y_cols)
    n_x, n_y = len(x_cols), len(y_cols)
    weight = F.lit(1.0) if weight is None else weight
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x_cols)],
                     *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(y_cols)], weight.cast("double").alias("w")).na.drop()
    held = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) < F.lit(int(held_share * (1 << 20)))

    def cut(batches):
        number = 0
        for batch in batches:
            m = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_x + n_y + 1)], axis=1)
            out = batch.column(n_x + n_y + 1).to_numpy(zero_copy_only=False).astype(bool)
            found = []
            for flag in (False, True):
                mine = m[out == flag]
                for at in range(0, len(mine), BLOCK_ROWS):
                    b = mine[at:at + BLOCK_ROWS]
                    found.append((number, flag, len(b), b[:, :n_x].tobytes(), b[:, n_x:n_x + n_y].tobytes(), b[:, -1].tobytes()))
                    number += not flag
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["part", "held", "n", "x", "y", "w"])

    path = scratch_path(df.sparkSession, "network-blocks")
    rows.withColumn("held", held).mapInArrow(cut, _BLOCK).write.parquet(path)
    return keep(df.sparkSession.read.schema(_BLOCK).parquet(path))


def _add(batches):
    total = None
    for batch in batches:
        for r in batch.to_pylist():
            now = np.array([r["loss"], r["weight"], r["held_loss"], r["held_weight"], *np.frombuffer(r["gradient"])])
            total = now if total is None else total + now
    if total is not None:
        yield pa.RecordBatch.from_pylist([dict(loss=total[0], weight=total[1], held_loss=total[2], held_weight=total[3],
                                               gradient=total[4:].tobytes())])


def summed(blocks: DataFrame, shape: Shape, flat: np.ndarray, fan_in: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """((loss, weight, loss of held rows, their weight), gradient): sums over all blocks; held rows add no gradient.
    ``fan_in``: add the tasks' sums in so many tasks first."""
    n_x, n_y = shape.sizes[0], shape.sizes[-1]

    def task(batches):
        sums, gradient = np.zeros(4), np.zeros(len(flat))
        for batch in batches:
            for r in batch.to_pylist():
                w = np.frombuffer(r["w"])
                x, y = np.frombuffer(r["x"]).reshape(-1, n_x), np.frombuffer(r["y"]).reshape(-1, n_y)
                loss, part = loss_and_gradient(shape, flat, x, y, w, gradient=not r["held"])
                sums[2 * r["held"]:2 * r["held"] + 2] += loss, w.sum()
                if part is not None:
                    gradient += part
        yield pa.RecordBatch.from_pylist([dict(loss=sums[0], weight=sums[1], held_loss=sums[2], held_weight=sums[3],
                                               gradient=gradient.tobytes())])

    parts = blocks.mapInArrow(task, _SUM)
    if fan_in:
        parts = parts.repartition(fan_in).mapInArrow(_add, _SUM)
    rows = parts.collect()
    return (np.sum([[r["loss"], r["weight"], r["held_loss"], r["held_weight"]] for r in rows], axis=0),
            np.sum([np.frombuffer(r["gradient"]) for r in rows], axis=0))


@dataclass
class Fitted:
    shape: Shape
    layers: list                                     # [(weights, bias)], as ``models.dense_forward`` takes them
    history: list = field(default_factory=list)      # (training loss, validation loss) by epoch

    @property
    def activations(self) -> list[str]:
        return self.shape.activations


def fit(blocks: DataFrame, shape: Shape, epochs: int = 40, rate: float = 0.02, batches: int = 1, patience: int = 8,
        seed: int = 42) -> Fitted:
    """Adam with ``batches`` mini-batches an epoch (blocks by their number), early stopping, the best weights of all epochs.
    Without validation rows the training loss decides."""
    flat = shape.start(seed)
    first, second, step = np.zeros_like(flat), np.zeros_like(flat), 0
    best, best_flat, since, history = np.inf, flat, 0, []
    fan_in = FAN_IN if blocks.rdd.getNumPartitions() > FAN_IN else None
    for _ in range(epochs + 1):
        before = flat
        for part in range(batches):
            chosen = blocks if batches == 1 else blocks.where((F.col("part") % batches == part) & ~F.col("held")
                                                              | (F.col("held") & F.lit(part == 0)))
            sums, gradient = summed(chosen, shape, flat, fan_in)
            if part == 0:                                # measured before this epoch's first step
                held = sums[2] / sums[3] if sums[3] else sums[0] / max(sums[1], 1.0)
                history.append((sums[0] / max(sums[1], 1.0), held))
            step += 1
            gradient = gradient / max(sums[1], 1.0)
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
            flat = flat - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        if held < best - 1e-6:
            best, best_flat, since = held, before, 0
        else:
            since += 1
            if since >= patience:
                break
    return Fitted(shape, [(w.copy(), b.copy()) for w, b in shape.layers(best_flat)], history)
