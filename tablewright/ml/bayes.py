"""Gaussian naive Bayes from sufficient statistics.

One pass gives each class its count, means and variances; every smoothing of the variances is then a
matter of these few numbers, so a search over it reads the data once a trial and nothing is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.ml.stages import Stage


class GaussianScores(Stage):
    """Class probabilities of ``features`` that are independent normal variables in each class."""

    logs = Param(Params._dummy(), "logs", "logarithms of the class shares", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means, class by class", TypeConverters.toListFloat)
    variances = Param(Params._dummy(), "variances", "smoothed variances, class by class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, logs=None, means=None, variances=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        logs = np.array(self.getOrDefault("logs"))
        means = np.array(self.getOrDefault("means")).reshape(len(logs), -1)
        variances = np.array(self.getOrDefault("variances")).reshape(len(logs), -1)
        constant = logs - 0.5 * np.log(2 * np.pi * variances).sum(axis=1)

        @F.pandas_udf("array<double>")
        def shares(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_numpy())
            joint = np.stack([c - 0.5 * ((x - m) ** 2 / v).sum(axis=1) for c, m, v in zip(constant, means, variances, strict=True)], axis=1)
            joint = np.exp(joint - joint.max(axis=1, keepdims=True))
            return pd.Series(list(joint / joint.sum(axis=1, keepdims=True)))

        found = df.withColumn("probability", array_to_vector(shares(vector_to_array("features"))))
        share = vector_to_array("probability")
        return found.withColumn("prediction", (F.array_position(share, F.array_max(share)) - 1).cast("double"))


def fit_gaussian_bayes(df: DataFrame, n_classes: int, smoothing: float = 1e-9) -> GaussianScores:
    """Fit on ``features`` and ``label``; ``smoothing`` times the largest variance of a feature over
    all rows is added to each variance. A class without rows has no share."""
    # one aggregate, centred inside: counts, means and sample variances of each class
    rows = (
        df.groupBy("label")
        .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s"))
        .select("label", "s.*")
        .collect()
    )
    width = len(rows[0]["mean"])
    counts = np.zeros(n_classes)
    means, squares = np.zeros((n_classes, width)), np.zeros((n_classes, width))
    for r in rows:
        c, n = int(r["label"]), r["count"]
        counts[c], means[c] = n, r["mean"].toArray()
        squares[c] = r["variance"].toArray() * (n - 1) if n > 1 else 0.0
    total = counts.sum()
    centre = counts @ means / total
    overall = (squares.sum(axis=0) + counts @ (means - centre) ** 2) / total
    added = smoothing * overall.max()
    variances = np.maximum(squares / np.maximum(counts, 1)[:, None] + added, np.finfo(float).tiny)
    with np.errstate(divide="ignore"):
        logs = np.where(counts > 0, np.log(np.maximum(counts, 1) / total), -1e300)
    return GaussianScores(logs=logs.tolist(), means=means.ravel().tolist(), variances=variances.ravel().tolist())
