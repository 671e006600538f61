"""Small Spark ML transformers that save and load with a pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are mapped at once.
ROWS_AT_ONCE = 1_000


class Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Common base: parameters only, no state."""


class FourierFeatures(Stage, HasInputCol, HasOutputCol):
    """Random Fourier features of the Gaussian kernel (Rahimi and Recht, 2007)."""

    weights = Param(Params._dummy(), "weights", "flat matrix", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "phases", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, weights=None, offsets=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        offsets = np.array(self.getOrDefault("offsets"))
        weights = np.array(self.getOrDefault("weights")).reshape(-1, len(offsets))
        scale = np.sqrt(2.0 / len(offsets))

        @F.pandas_udf("array<double>")
        def project(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            x, waves = np.stack(vectors.to_numpy()), np.empty((len(vectors), len(offsets)))
            for start in range(0, len(x), ROWS_AT_ONCE):
                waves[start : start + ROWS_AT_ONCE] = np.cos(x[start : start + ROWS_AT_ONCE] @ weights + offsets) * scale
            return pd.Series(list(waves))

        projected = project(vector_to_array(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(projected))


class LinearScores(Stage, HasInputCol, HasOutputCol):
    """A weighted sum of a vector's elements plus an intercept."""

    weights = Param(Params._dummy(), "weights", "one for each element", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "added to the sum", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, weights=None, intercept=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        # one literal: the optimizer folds it once per plan
        weights = F.split(F.lit(",".join(map(repr, self.getOrDefault("weights")))), ",").cast("array<double>")
        products = F.zip_with(vector_to_array(self.getInputCol()), weights, lambda x, w: x * w)
        total = F.aggregate(products, F.lit(self.getOrDefault("intercept")), lambda s, p: s + p)
        return df.withColumn(self.getOutputCol(), total)


class MarginVector(Stage, HasInputCol, HasOutputCol):
    """One-element vector with the margin of a binary classifier's raw prediction."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        margin = F.get(vector_to_array(self.getInputCol()), F.lit(1))
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(margin)))


class OneVsRestVote(Stage, HasInputCols):
    """Normalise the positive-class probabilities of binary models; predict the largest."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = [F.get(vector_to_array(c), F.lit(1)) for c in self.getInputCols()]
        total = sum(parts[1:], parts[0])
        share = F.array(*[F.when(total > 0, p / total).otherwise(1.0 / len(parts)) for p in parts])
        best = (F.array_position(share, F.array_max(share)) - 1).cast("double")
        return df.withColumn("probability", array_to_vector(share)).withColumn("prediction", best)


class DropColumns(Stage, HasInputCols):
    """Drop intermediate columns."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getInputCols())


class ClassPositions(Stage, HasInputCol, HasOutputCol):
    """The label as 1 (the given class) or 0 (any other)."""

    position = Param(Params._dummy(), "position", "class position", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, position=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        hit = F.col(self.getInputCol()) == F.lit(self.getOrDefault("position"))
        return df.withColumn(self.getOutputCol(), hit.cast("double"))
