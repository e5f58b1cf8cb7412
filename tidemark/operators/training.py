"""Training a classifier's last layers over feature vectors, a task's rows at a time.

The model is a linear trunk over features and a linear head. An epoch is one pass over the data: every
task takes AdamW steps over batches of its own rows, from the same weights, and the weights that come
back are averaged by rows. The trunk is frozen in the first epochs and learns at a tenth of the head's
rate, which falls along a half cosine. What the driver holds is weights: a set for each task.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FROZEN_EPOCHS, TRUNK_RATE = 5, 0.1
BETA1, BETA2, EPSILON, DECAY = 0.9, 0.999, 1e-8, 0.01


@dataclass
class Head:
    classes: list[str]
    trunk: np.ndarray
    head: np.ndarray
    bias: np.ndarray
    history: list[dict] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x + x @ self.trunk) @ self.head + self.bias


def device(available: Sequence[str]) -> str:
    """Where a model runs: Apple's or NVIDIA's processor, if there is one, or the CPU."""
    return next((d for d in ("mps", "cuda:0") if d.split(":")[0] in available), "cpu")


def rate(start: float, epoch: int, epochs: int) -> float:
    """The head's learning rate in an epoch (from 0), along a half cosine down to 0 after the last."""
    return start * (1 + math.cos(math.pi * epoch / epochs)) / 2


def new_head(classes: Sequence[str], width: int, seed: int = 0) -> Head:
    rnd = np.random.default_rng(seed)
    return Head(sorted(classes), np.zeros((width, width)), rnd.uniform(-1, 1, (width, len(classes))) / math.sqrt(width), np.zeros(len(classes)))


def _loss(model: Head, x: np.ndarray, y: np.ndarray) -> tuple[float, int, np.ndarray]:
    z = model.logits(x)
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()), int((p.argmax(axis=1) == y).sum()), p


def _pass(model: Head, lr: float, frozen: bool, batch: int):
    """Rows of y, x -> loss, correct, n and, with a rate, the weights after this task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Head(model.classes, model.trunk.copy(), model.head.copy(), model.bias.copy())
        weights = [own.trunk, own.head, own.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        loss, right, n = 0.0, 0, 0
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                y, x = some.column(0).to_numpy(), np.array(some.column(1).to_pylist())
                more, correct, p = _loss(own, x, y)
                loss, right, n = loss + more, right + correct, n + len(y)
                if not lr:
                    continue
                step += 1
                p[np.arange(len(y)), y] -= 1
                d = p / len(y)
                grads = [x.T @ (d @ own.head.T), (x + x @ own.trunk).T @ d, d.sum(axis=0)]
                for i, (w, g) in enumerate(zip(weights, grads, strict=True)):
                    if frozen and not i:
                        continue
                    pace = lr * (1.0 if i else TRUNK_RATE)
                    first[i] = BETA1 * first[i] + (1 - BETA1) * g
                    second[i] = BETA2 * second[i] + (1 - BETA2) * g * g
                    w -= pace * (DECAY * w + first[i] / (1 - BETA1**step) / (np.sqrt(second[i] / (1 - BETA2**step)) + EPSILON))
        if n:
            flat = np.concatenate([w.ravel() for w in weights]).tobytes() if lr else b""
            yield pa.record_batch([pa.array([loss]), pa.array([right], pa.int64()), pa.array([n], pa.int64()), pa.array([flat], pa.binary())], names=["loss", "correct", "n", "weights"])

    return run


def _epoch(rows: DataFrame, model: Head, lr: float = 0.0, frozen: bool = False, batch: int = 32) -> tuple[Head, float, float]:
    """The model after an epoch, with the mean loss and the accuracy over its rows."""
    done = rows.mapInArrow(_pass(model, lr, frozen, batch), "loss double, correct long, n long, weights binary").collect()  # a row a task
    n = sum(r["n"] for r in done)
    if lr and n:
        flat = sum(np.frombuffer(r["weights"]) * (r["n"] / n) for r in done)
        cuts = np.cumsum([model.trunk.size, model.head.size])
        parts = [p.reshape(w.shape) for p, w in zip(np.split(flat, cuts), (model.trunk, model.head, model.bias), strict=True)]
        model = Head(model.classes, *parts, model.history)
    return model, sum(r["loss"] for r in done) / max(n, 1), sum(r["correct"] for r in done) / max(n, 1)


def fit_head(split: DataFrame, label: str, vector: str, classes: Sequence[str], *, epochs: int = 30, lr: float = 1e-3, patience: int = 7, batch: int = 32) -> Head:
    """The model of the first epoch with the best accuracy on rows whose ``split`` is not train. Training
    stops after ``patience`` epochs without a better one. An error for fewer than two classes."""
    if len(set(classes)) < 2:
        raise ValueError("training needs two classes at least")
    names = sorted(classes)
    numbers = F.array_position(F.array(*[F.lit(c) for c in names]), F.col(label).cast("string")) - 1
    rows = split.select((F.col("split") == "train").alias("train"), numbers.cast("long").alias("y"), F.col(vector).cast("array<double>").alias("x"))
    train, held = (rows.filter(F.col("train") == t).select("y", "x") for t in (True, False))
    model = best = new_head(names, len(rows.first()["x"]))
    top, streak = 0.0, 0
    for epoch in range(epochs):
        model, loss, accuracy = _epoch(train, model, rate(lr, epoch, epochs), epoch < FROZEN_EPOCHS, batch)
        _, held_loss, held_accuracy = _epoch(held, model)
        model.history.append({"epoch": epoch + 1, "train_loss": loss, "train_accuracy": accuracy, "val_loss": held_loss, "val_accuracy": held_accuracy})
        streak += 1
        if held_accuracy > top:
            top, streak, best = held_accuracy, 0, model
        if streak >= patience:
            break
    best.history = model.history
    return best
