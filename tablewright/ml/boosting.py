"""Boosted regression trees on cells of rows.

Spark's boosted trees see a row only through its bins: between which candidate thresholds of each feature
it lies. With squared errors, the rows of a cell, alike in all bins, count only by their number and the
mean of their labels. So the thresholds are found on the rows, as Spark finds them; one pass packs the
rows into weighted cells; the trees are boosted on the cells; and their cuts between bins get their
thresholds back. The model is that of the rows, up to the last digits of sums; a stage costs what the
cells cost, not what the rows do.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Params
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

#: Cells that a task holds before it gives them out.
CELLS_AT_ONCE = 200_000
#: Rows of a partition from which Spark's trees are grown: every stage reads a whole one again.
PART_ROWS = 50_000


def _only(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def candidate_thresholds(df: DataFrame, trees: GBTRegressor) -> list[np.ndarray | None]:
    """Of every feature the thresholds that Spark would try on these rows; of a categorical one none."""
    trees._transfer_params_to_java()
    java, jvm = trees._java_obj, df.sparkSession.sparkContext._jvm
    ml, scala = jvm.org.apache.spark.ml, jvm.scala
    categories = ml.util.MetadataUtils.getCategoricalFeatures(df._jdf.schema().apply(trees.getFeaturesCol()))
    regression = jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
    strategy = java.getOldBoostingStrategy(categories, regression).treeStrategy()
    rows = _only(ml.util, "DatasetUtils").extractInstances(java, df._jdf, _only(scala, "None"))
    about = _only(ml.tree.impl, "DecisionTreeMetadata").buildMetadata(rows, strategy, 1, trees.getFeatureSubsetStrategy())
    found = _only(ml.tree.impl, "RandomForest").findSplits(rows, about, trees.getSeed())
    return [None if about.isCategorical(f) else np.array([s.threshold() for s in splits]) for f, splits in enumerate(found)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their sums, with equal cells added up."""
    x, sums = (np.concatenate(p) for p in zip(*parts, strict=True))
    if not x.shape[1]:
        return x[:1], sums.sum(axis=0, keepdims=True)
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, cell = np.unique(keys, return_index=True, return_inverse=True)
    return x[first], np.column_stack([np.bincount(cell, s, len(first)) for s in sums.T])


def pack_cells(df: DataFrame, thresholds: list[np.ndarray | None], features: str = "features", label: str = "label") -> DataFrame:
    """``x, n, total`` of the cells of the rows: the bin of each feature (of a categorical one its value),
    the number of rows and the sum of their labels."""

    def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        # a value on a threshold lies below it; + 0.0: there is one zero
        bins = [x[:, f] + 0.0 if t is None else np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds)]
        return _merged([(np.column_stack(bins).astype(float), np.column_stack([np.ones(len(y)), y]))])

    def table(x: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(ends, x.ravel()), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1])], ["x", "n", "total"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(cells(batch))
            size += len(held[-1][0])
            if size > CELLS_AT_ONCE:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > CELLS_AT_ONCE // 2:  # few are alike
                    yield table(*held[0])
                    held, size = [], 0
        if held:
            yield table(*_merged(held))

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    packed = rows.mapInArrow(run, "x array<double>, n bigint, total double")
    return packed.groupBy("x").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _on_thresholds(node, thresholds: list[np.ndarray | None], tree):
    """A node of Spark's with the cuts between bins replaced by thresholds, and all below it."""
    if not node.numDescendants():
        return node
    split = node.split()
    f = split.featureIndex()
    if thresholds[f] is not None:
        split = tree.ContinuousSplit(f, float(thresholds[f][math.floor(split.threshold())]))
    left, right = (_on_thresholds(n, thresholds, tree) for n in (node.leftChild(), node.rightChild()))
    return tree.InternalNode(node.prediction(), node.impurity(), node.gain(), left, right, split, node.impurityStats())


def fit_on_cells(df: DataFrame, trees: GBTRegressor) -> GBTRegressionModel:
    """What ``trees.fit(df)`` gives, by way of the cells. Only for squared errors and all rows in every stage."""
    thresholds = candidate_thresholds(df, trees)
    packed = cut_lineage(pack_cells(df, thresholds, trees.getFeaturesCol(), trees.getLabelCol()))
    n_cells = packed.count()
    bins = max([trees.getMaxBins(), *[len(t) + 1 for t in thresholds if t is not None]])
    # Spark wants a row for each category: few cells are dealt out over copies that share their weight
    copies = 1 if n_cells >= bins else 1 << math.ceil(math.log2(bins))
    shared = packed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    column = F.col("x") if thresholds else F.array().cast("array<double>")
    cells = shared.select(
        array_to_vector(column).alias(trees.getFeaturesCol(), metadata=df.schema[trees.getFeaturesCol()].metadata),
        (F.col("total") / F.col("n")).alias(trees.getLabelCol()),
        (F.col("n") / copies).alias("_weight"),
        "x", "_copy",
    )
    cells = cells.repartition(math.ceil(n_cells * copies / PART_ROWS), "x", "_copy").sortWithinPartitions("x", "_copy").drop("x", "_copy")
    grown = trees.copy().setWeightCol("_weight").setMaxBins(bins).fit(cells)
    context = df.sparkSession.sparkContext
    ml = context._jvm.org.apache.spark.ml
    java = grown._java_obj
    stages = java.trees()
    kept = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(stages))
    for i, stage in enumerate(stages):
        kept[i] = ml.regression.DecisionTreeRegressionModel(_on_thresholds(stage.rootNode(), thresholds, ml.tree), java.numFeatures())
    name = f"GBTRegressionModel_{uuid.uuid4().hex[:12]}"
    model = GBTRegressionModel(ml.regression.GBTRegressionModel(name, kept, java.treeWeights(), java.numFeatures()))
    return Params._copyValues(trees, model)
