"""The trainable algorithms, their defaults and search spaces.

An algorithm is a spec with a ``fit(df, context, params)`` function that takes a frame with
``features`` and ``label`` and returns a model whose ``transform`` adds ``prediction`` and, for
classes, ``probability``. Own algorithms are added with :func:`register_algorithm`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.ml.bayes import fit_gaussian_bayes
from tablewright.ml.boosting import PART_ROWS, fit_on_cells
from tablewright.ml.forest import Forest, TreeRule
from tablewright.ml.insensitive import fit_insensitive
from tablewright.ml.knn import NearestNeighbours
from tablewright.ml.stages import ClassPositions, DropColumns, FourierFeatures, MarginVector, OneVsRestVote

CLASSIFICATION, REGRESSION = "classification", "regression"
TASKS = (CLASSIFICATION, REGRESSION)

DEFAULT_TREES = 100
FOURIER_FEATURES = 256


@dataclass(frozen=True)
class Context:
    """What a fit needs to know besides the data."""

    task: str
    n_rows: int
    n_classes: int = 0
    seed: int = 42

    @property
    def classes(self) -> bool:
        return self.task == CLASSIFICATION


# Search spaces -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whole:
    """A whole number in a closed range, in steps."""

    low: int
    high: int
    step: int = 1

    def draw(self, rng: np.random.Generator) -> int:
        return int(self.low + self.step * rng.integers(0, (self.high - self.low) // self.step + 1))


@dataclass(frozen=True)
class Real:
    """A real number in a closed range, uniform or log-uniform."""

    low: float
    high: float
    log: bool = False

    def draw(self, rng: np.random.Generator) -> float:
        if self.log:
            return float(math.exp(rng.uniform(math.log(self.low), math.log(self.high))))
        return float(rng.uniform(self.low, self.high))


@dataclass(frozen=True)
class Choice:
    """One of several values."""

    values: tuple

    def draw(self, rng: np.random.Generator):
        return self.values[int(rng.integers(len(self.values)))]


Space = dict[str, Whole | Real | Choice]

# The bounds of the search spaces.
FOREST_SPACE: Space = {
    "n_estimators": Whole(100, 500, 50),
    "max_depth": Whole(3, 20),
    "min_samples_split": Whole(2, 10),
    "min_samples_leaf": Whole(1, 5),
    "max_features": Choice(("sqrt", "log2", "all")),
}
BOOSTING_SPACE: Space = {
    "n_estimators": Whole(100, 400, 50),
    "learning_rate": Real(0.01, 0.3, log=True),
    "max_depth": Whole(2, 6),
    "subsample": Real(0.6, 1.0),
}
LOGISTIC_SPACE: Space = {"C": Real(1e-3, 1e2, log=True)}
RIDGE_SPACE: Space = {"alpha": Real(1e-3, 1e2, log=True)}
SVM_SPACE: Space = {
    "C": Real(1e-2, 1e2, log=True),
    "kernel": Choice(("rbf", "linear")),
    "gamma": Choice(("scale", "auto")),
}
KNN_SPACE: Space = {"n_neighbors": Whole(3, 30), "weights": Choice(("uniform", "distance"))}
TREE_SPACE: Space = {"max_depth": Whole(2, 20), "min_samples_split": Whole(2, 20), "min_samples_leaf": Whole(1, 10)}
BAYES_SPACE: Space = {"var_smoothing": Real(1e-11, 1e-6, log=True)}


@dataclass(frozen=True)
class AlgorithmSpec:
    """One trainable algorithm."""

    key: str
    display_name: str
    tasks: tuple[str, ...]
    fit: Callable[[DataFrame, Context, dict[str, Any]], Any]
    spaces: dict[str, Space] = field(default_factory=dict)

    def draw(self, task: str, rng: np.random.Generator) -> dict[str, Any]:
        """One random setting of the search space."""
        return {name: domain.draw(rng) for name, domain in self.spaces.get(task, {}).items()}


# Fits ----------------------------------------------------------------------------------------


def _grown(df, context, params, *, trees: int, tried: str, random_cuts: bool = False, bootstrap: bool = False) -> Forest:
    """Trees by the settings of the search spaces; leaves stay pure or single unless these stop them."""
    width = df.select(F.size(vector_to_array("features"))).first()
    width = width[0] if width else 1
    depth = params.get("max_depth")
    counts = {"sqrt": math.isqrt(width), "log2": int(math.log2(max(width, 1))), "all": width}
    rule = TreeRule(
        classes=context.n_classes if context.classes else 0,
        tried=max(1, counts[params.get("max_features", tried)]),
        max_depth=None if depth is None else int(depth),
        min_leaf=int(params.get("min_samples_leaf", 1)),
        min_split=int(params.get("min_samples_split", 2)),
        random_cuts=random_cuts,
        bootstrap=bootstrap,
        trees=trees,
        seed=context.seed,
    )
    return Forest.fit(df, rule)


def _fit_forest(df, context, params):
    """Bootstrap samples, the best cut of some features at each node."""
    trees = int(params.get("n_estimators", DEFAULT_TREES))
    return _grown(df, context, params, trees=trees, tried="sqrt" if context.classes else "all", bootstrap=True)


def _fit_tree(df, context, params):
    return _grown(df, context, params, trees=1, tried="all")


def _fit_extra_trees(df, context, params):
    """All rows for each tree, one cut drawn in the node's own range for each of some features."""
    trees = int(params.get("n_estimators", DEFAULT_TREES))
    return _grown(df, context, params, trees=trees, tried="sqrt" if context.classes else "all", random_cuts=True)


def _element_ranges(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum, maximum and variance of every vector element."""
    s = df.select(
        Summarizer.metrics("min", "max", "variance").summary(F.col("features")).alias("s")
    ).first()["s"]
    return s["min"].toArray(), s["max"].toArray(), s["variance"].toArray()


def _one_vs_rest(df, context, fit_binary):
    """One binary model per class; ``fit_binary(frame, i)`` returns stages writing ``_p{i}``."""
    stages, columns = [], []
    for i in range(context.n_classes):
        marked = ClassPositions(inputCol="label", outputCol="_hit", position=float(i)).transform(df)
        stages += fit_binary(marked, i)
        columns.append(f"_p{i}")
    return [*stages, OneVsRestVote(inputCols=columns)], columns


def _spread_rows(df: DataFrame, n_rows: int) -> DataFrame:
    """At least one partition for each ``PART_ROWS`` rows: every stage reads a whole one again."""
    return df.repartition(math.ceil(n_rows / PART_ROWS)) if n_rows > PART_ROWS else df


def _fit_boosting(df, context, params):
    settings = {
        "maxIter": int(params.get("n_estimators", DEFAULT_TREES)),
        "stepSize": float(params.get("learning_rate", 0.1)),
        "maxDepth": int(params.get("max_depth", 3)),
        "subsamplingRate": float(params.get("subsample", 1.0)),
        "seed": context.seed,
    }
    if not context.classes and settings["subsamplingRate"] == 1.0:
        return fit_on_cells(df, GBTRegressor(**settings))
    df = _spread_rows(df, context.n_rows)
    if not context.classes:
        return GBTRegressor(**settings).fit(df)
    if context.n_classes == 2:
        return GBTClassifier(**settings).fit(df)

    def fit_binary(marked, i):
        trees = GBTClassifier(labelCol="_hit", predictionCol=f"_c{i}", **settings)
        trees = trees.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
        return [trees.fit(marked), DropColumns(inputCols=[f"_r{i}", f"_c{i}"])]

    stages, columns = _one_vs_rest(df, context, fit_binary)
    return PipelineModel([*stages, DropColumns(inputCols=columns)])


def _ridge(df, column, penalty):
    """Least squares with ``penalty / 2 * |w|^2`` added to half the mean squared error."""
    # the solver scales the penalty by the label's deviation; undo that
    spread = df.agg(F.stddev_pop("label").alias("s")).first()["s"] or 1.0
    return LinearRegression(
        featuresCol=column, regParam=penalty * spread, elasticNetParam=0.0, standardization=False
    ).fit(df)


def _fit_linear(df, context, params):
    if context.classes:
        return LogisticRegression(
            regParam=1.0 / (float(params.get("C", 1.0)) * context.n_rows),
            standardization=False,
            maxIter=100,
        ).fit(df)
    return _ridge(df, "features", float(params.get("alpha", 1.0)) / context.n_rows)


def _kernel_map(df, context, params) -> FourierFeatures | None:
    """Random Fourier features of the Gaussian kernel, or nothing for the linear kernel."""
    if params.get("kernel", "rbf") == "linear":
        return None
    low, _, variance = _element_ranges(df)
    width = len(low)
    gamma = 1.0 / width
    if params.get("gamma", "scale") == "scale":
        means = df.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
        spread = float(np.mean(variance) + np.var(means))  # variance over all entries
        gamma = gamma / spread if spread > 0 else 1.0
    rng = np.random.default_rng(context.seed)
    return FourierFeatures(
        inputCol="features",
        outputCol="_waves",
        weights=rng.normal(0, math.sqrt(2 * gamma), width * FOURIER_FEATURES).tolist(),
        offsets=rng.uniform(0, 2 * math.pi, FOURIER_FEATURES).tolist(),
    )


def _fit_svm(df, context, params):
    """Linear SVM, on kernel features for ``rbf``.

    Class probabilities come from a logistic fit on the margin. Regression leaves errors up to
    ``epsilon`` unpunished and counts the rest by its amount (``fit_insensitive``).
    """
    waves = _kernel_map(df, context, params)
    if not context.classes:
        settings = float(params.get("C", 1.0)), float(params.get("epsilon", 0.1))
        return fit_insensitive(df, waves, *settings)
    if waves is None:
        return PipelineModel(_svm_stages(df, "features", context, params))
    frame = waves.transform(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stages = _svm_stages(frame, "_waves", context, params)
    finally:
        frame.unpersist()
    return PipelineModel([waves, *stages, DropColumns(inputCols=["_waves"])])


def _svm_stages(frame, column, context, params) -> list:
    penalty = 1.0 / (float(params.get("C", 1.0)) * context.n_rows)

    def fit_binary(marked, i):
        machine = LinearSVC(
            featuresCol=column, labelCol="_hit", rawPredictionCol=f"_r{i}",
            predictionCol=f"_c{i}", regParam=penalty, standardization=False, tol=1e-4,
        ).fit(marked)
        margin = MarginVector(inputCol=f"_r{i}", outputCol=f"_m{i}")
        curve = LogisticRegression(
            featuresCol=f"_m{i}", labelCol="_hit", probabilityCol=f"_p{i}",
            rawPredictionCol=f"_q{i}", predictionCol=f"_d{i}",
        ).fit(margin.transform(machine.transform(marked)))
        return [machine, margin, curve]

    def leftovers(i, names="rcmqd"):
        return [f"_{c}{i}" for c in names]

    if context.n_classes == 2:  # one machine: its second class against its first
        marked = ClassPositions(inputCol="label", outputCol="_hit", position=1.0).transform(frame)
        machine, margin, curve = fit_binary(marked, 0)
        curve = curve.setProbabilityCol("probability").setPredictionCol("prediction")
        return [machine, margin, curve, DropColumns(inputCols=leftovers(0, "rcmq"))]

    def one(marked, i):
        return [*fit_binary(marked, i), DropColumns(inputCols=leftovers(i))]

    stages, columns = _one_vs_rest(frame, context, one)
    return [*stages, DropColumns(inputCols=columns)]


def _fit_knn(df, context, params):
    return NearestNeighbours.fit(
        df,
        k=int(params.get("n_neighbors", 5)),
        weighting=params.get("weights", "uniform"),
        n_classes=context.n_classes if context.classes else 0,
    )


def _fit_bayes(df, context, params):
    return fit_gaussian_bayes(df, context.n_classes, float(params.get("var_smoothing", 1e-9)))


def _both(space: Space) -> dict[str, Space]:
    return {CLASSIFICATION: space, REGRESSION: space}


_REGISTRY: dict[str, AlgorithmSpec] = {}


def register_algorithm(spec: AlgorithmSpec) -> AlgorithmSpec:
    """Add (or replace) an algorithm."""
    _REGISTRY[spec.key] = spec
    return spec


for _spec in (
    AlgorithmSpec("random_forest", "Random Forest", TASKS, _fit_forest, _both(FOREST_SPACE)),
    AlgorithmSpec("extra_trees", "Extra Trees", TASKS, _fit_extra_trees, _both(FOREST_SPACE)),
    AlgorithmSpec("gradient_boosting", "Gradient Boosting", TASKS, _fit_boosting, _both(BOOSTING_SPACE)),
    AlgorithmSpec(
        "logistic_regression", "Logistic / Linear Regression", TASKS, _fit_linear,
        {CLASSIFICATION: LOGISTIC_SPACE, REGRESSION: RIDGE_SPACE},
    ),
    AlgorithmSpec("svm", "Support Vector Machine", TASKS, _fit_svm, _both(SVM_SPACE)),
    AlgorithmSpec("knn", "K-Nearest Neighbours", TASKS, _fit_knn, _both(KNN_SPACE)),
    AlgorithmSpec("decision_tree", "Decision Tree", TASKS, _fit_tree, _both(TREE_SPACE)),
    AlgorithmSpec("naive_bayes", "Gaussian Naive Bayes", (CLASSIFICATION,), _fit_bayes, {CLASSIFICATION: BAYES_SPACE}),
):
    register_algorithm(_spec)


def algorithms_by_task() -> dict[str, dict[str, AlgorithmSpec]]:
    """For each task its algorithms by key, in the order in which they were registered."""
    return {t: {k: spec for k, spec in _REGISTRY.items() if t in spec.tasks} for t in TASKS}


def available_keys(task: str) -> list[str]:
    """Keys of the algorithms that a task can be trained with here."""
    return list(algorithms_by_task().get(task, {}))


def get_algorithm(key: str) -> AlgorithmSpec:
    """What is registered as ``key``; the error names what there is."""
    spec = _REGISTRY.get(key)
    if spec is None:
        raise KeyError(f"{key!r} is not among {', '.join(_REGISTRY)}; its library may not be installed")
    return spec
