"""Principal directions by subspace iteration on vectors as they are, sparse ones included.

A block of directions is multiplied by the covariance matrix without forming it: rows are projected
on the block, and the projections are the weights of summaries that add the rows up again; centring is
a correction on the driver. Only numbers of the size width x block are gathered. A block as wide as the
vectors needs one such pass and is exact; a narrower one is repeated until its directions hold still
(Halko, Martinsson and Tropp, 2011).
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARE = 10  # directions beyond those asked for, which speed up the others
FIRST_BLOCK = 32  # directions tried first when a share of the variance is asked for
TOLERANCE = 1e-5  # of directions; their variances are right to its square
MOST_PASSES = 60


def projection(directions: np.ndarray, column: str, out: str) -> PCAModel:
    """A stage that multiplies vectors by the given directions (one a column)."""
    context = SparkSession.active().sparkContext
    rows, columns = directions.shape
    matrix = _py2java(context, DenseMatrix(rows, columns, directions.ravel(order="F").tolist()))
    shares = _py2java(context, DenseVector(np.zeros(columns)))
    model = context._jvm.org.apache.spark.ml.feature.PCAModel(f"PCA_{uuid.uuid4().hex[:12]}", matrix, shares)
    return PCAModel(model)._set(k=columns, inputCol=column, outputCol=out)


class _Covariance:
    """Multiplies blocks of directions by the covariance matrix of a column of vectors."""

    def __init__(self, df: DataFrame, column: str):
        self.df, self.column = df.select(column), column
        s = self.df.agg(Summarizer.metrics("count", "mean", "variance", "max", "min").summary(F.col(column)).alias("s")).first()["s"]
        self.n, self.mean = s["count"], s["mean"].toArray()
        self.total = float(s["variance"].toArray().sum())
        self.width = len(self.mean)
        self.largest = np.maximum(np.abs(s["max"].toArray()), np.abs(s["min"].toArray()))

    def times(self, block: np.ndarray) -> np.ndarray:
        # weights must not be negative: each projection is raised by a bound of its size
        raised = self.largest @ np.abs(block) + 1e-300
        projected = projection(block, self.column, "_y").transform(self.df).withColumn("_y", vector_to_array("_y"))
        weights = [F.get("_y", F.lit(j)) + float(r) for j, r in enumerate(raised)]
        summaries = [Summarizer.mean(F.col(self.column), w).alias(f"m{j}") for j, w in enumerate(weights)]
        row = projected.agg(*summaries, *[F.sum(w).alias(f"w{j}") for j, w in enumerate(weights)]).first()
        sums = np.column_stack([row[f"m{j}"].toArray() * row[f"w{j}"] for j in range(len(raised))])
        sums -= np.outer(self.mean * self.n, raised)
        return (sums - self.n * np.outer(self.mean, self.mean @ block)) / max(self.n - 1, 1)


def principal_directions(df: DataFrame, column: str, count: int | None, share: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` directions of greatest variance (None: all), or as many as hold more than ``share`` of
    it, as columns, and their variances. Signs: the largest entry of each is positive."""
    covariance = _Covariance(df, column)
    width = covariance.width
    limit = min(width, covariance.n)
    random = np.random.default_rng(0)
    size = min(width, FIRST_BLOCK if share is not None else limit if count is None else count + SPARE)
    block = np.eye(width) if size == width else np.linalg.qr(random.normal(size=(width, size)))[0]
    for step in range(MOST_PASSES):
        image = covariance.times(block)
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        wanted = count if count is not None else limit
        if share is not None:
            reached = np.cumsum(values) > share * covariance.total
            wanted = int(reached.argmax()) + 1 if reached.any() else size
        wanted = min(wanted, limit, size)
        off = np.linalg.norm(image @ turn[:, :wanted] - (block @ turn[:, :wanted]) * values[:wanted], axis=0)
        still = size == width or off.max(initial=0) <= TOLERANCE * max(values[0], 1e-300) or step == MOST_PASSES - 1
        if still and (share is None or size == width or reached.any()):
            break
        if share is not None and still or share is not None and not reached.any() and step % 4 == 3:
            size = min(width, 2 * size)  # the block holds too little of the variance
        more = random.normal(size=(width, size - block.shape[1]))
        block = np.eye(width) if size == width else np.linalg.qr(np.column_stack([image, more]))[0]
    directions = block @ turn[:, :wanted]
    strongest = np.abs(directions).argmax(axis=0)
    signs = np.where(directions[strongest, np.arange(wanted)] >= 0, 1.0, -1.0)
    return directions * signs, values[:wanted]
