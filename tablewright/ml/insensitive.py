"""Support vector regression: errors up to a tolerance are free, the rest counts by its amount.

The objective is ``|w|^2 / 2 + C * sum(max(0, |y - w z - b| - epsilon))`` with z the features or their
Fourier features. Its corners are rounded over a width that shrinks from step to step; each rounded
objective is a piecewise quadratic one, which Newton's method with a line search minimises in a few
steps. A step is two passes over the rows: tasks send gradient and curvature of their rows, which are
added in two levels, and then the loss at several step lengths. What is sent depends on the number
of features alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.ml.stages import DropColumns, FourierFeatures, LinearScores

#: Widths of the rounded corners, as parts of the labels' mean deviation; and Newton steps for each.
ROUNDINGS = (1.0, 0.2, 0.04, 0.008, 0.0016)
STEPS = 12
LENGTHS = tuple(0.5**k for k in range(12))
MERGED = 64
#: Rows whose Fourier features are held at once.
ROWS_AT_ONCE = 1_000


def _waves(fourier: FourierFeatures | None):
    """The map from features to z, with a one for the intercept."""
    if fourier is None:
        return lambda x: np.column_stack([x, np.ones(len(x))])
    offsets = np.array(fourier.getOrDefault("offsets"))
    weights = np.array(fourier.getOrDefault("weights")).reshape(-1, len(offsets))
    scale = np.sqrt(2.0 / len(offsets))
    return lambda x: np.column_stack([np.cos(x @ weights + offsets) * scale, np.ones(len(x))])


def _added(rows: DataFrame, measure) -> np.ndarray:
    """The sum over all rows of an array that ``measure(x, y)`` gives for some rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = batch.column("y").to_numpy()
                x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
                for start in range(0, len(y), ROWS_AT_ONCE):
                    found = measure(x[start : start + ROWS_AT_ONCE], y[start : start + ROWS_AT_ONCE])
                    total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in table["data"])
        return pa.table({"data": pa.array([total.tobytes()], pa.binary())})

    sent = rows.mapInArrow(send, "data binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    merged = sent.groupBy("part").applyInArrow(lambda t: merge(t.select(["data"])), "data binary").collect()
    return sum(np.frombuffer(r["data"]) for r in merged)


def _excess(residual: np.ndarray, epsilon: float) -> np.ndarray:
    return np.abs(residual) - epsilon


def _rounded(excess: np.ndarray, width: float) -> np.ndarray:
    """The loss with its corner rounded over ``width``."""
    inner = np.clip(excess, 0.0, width)
    return inner * inner / (2 * width) + np.maximum(excess - width, 0.0)


def minimise(rows: DataFrame, waves, size: int, cost: float, epsilon: float) -> np.ndarray:
    """Weights and intercept that minimise the objective over ``x, y`` up to the last rounding."""
    count, total, squares = _added(rows, lambda x, y: np.array([len(y), y.sum(), (y * y).sum()]))
    centre = total / count
    spread = float(np.sqrt(max(squares / count - centre**2, 0.0)))
    v = np.zeros(size)
    v[-1] = centre
    penalty = np.ones(size)
    penalty[-1] = 0.0
    if spread == 0:
        return v
    for part in ROUNDINGS:
        width = part * spread
        for _ in range(STEPS):

            def local(x, y, v=v, width=width):
                z = waves(x)
                residual = y - z @ v
                excess = _excess(residual, epsilon)
                pull = np.sign(residual) * np.clip(excess, 0.0, width) / width
                bent = z[(excess > 0) & (excess < width)]
                return np.r_[_rounded(excess, width).sum(), z.T @ pull, (bent.T @ bent).ravel() / width]

            found = _added(rows, local)
            loss = 0.5 * (penalty * v * v).sum() + cost * found[0]
            gradient = penalty * v - cost * found[1 : size + 1]
            bend = np.diag(penalty) + cost * found[size + 1 :].reshape(size, size)
            # a flat direction (no row in a corner) gets a small curvature
            bend += np.eye(size) * max(1e-8 * np.trace(bend) / size, 1e-12)
            step = -np.linalg.solve(bend, gradient)
            slope = float(gradient @ step)
            if -slope <= 1e-9 * max(1.0, abs(loss)):
                break

            def losses(x, y, v=v, step=step, width=width):
                z = waves(x)
                residual, move = y - z @ v, z @ step
                return np.array([_rounded(_excess(residual - a * move, epsilon), width).sum() for a in LENGTHS])

            moved = np.array([0.5 * (penalty * (v + a * step) ** 2).sum() for a in LENGTHS]) + cost * _added(rows, losses)
            best = int(np.argmin(moved))
            if moved[best] >= loss - 1e-12 * abs(loss):
                break
            gained = loss - moved[best]
            v = v + LENGTHS[best] * step
            if gained <= 1e-7 * abs(loss):
                break
    return v


def fit_insensitive(df: DataFrame, fourier: FourierFeatures | None, cost: float, epsilon: float) -> PipelineModel:
    """Fit on ``features`` and ``label``; without ``fourier`` the kernel is linear."""
    if cost <= 0 or epsilon < 0:
        raise ValueError("C must be positive and epsilon must not be negative")
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = held.select(F.size("x")).first()[0]
        size = (width if fourier is None else len(fourier.getOrDefault("offsets"))) + 1
        v = minimise(held, _waves(fourier), size, cost, epsilon)
    finally:
        held.unpersist()
    column = "features" if fourier is None else "_waves"
    scores = LinearScores(inputCol=column, outputCol="prediction", weights=v[:-1].tolist(), intercept=float(v[-1]))
    if fourier is None:
        return PipelineModel([scores])
    return PipelineModel([fourier, scores, DropColumns(inputCols=["_waves"])])
