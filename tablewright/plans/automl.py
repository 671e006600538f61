"""Training: split, tune, fit, evaluate, rank.

Feature pipelines are fitted once per training frame (and once per fold while tuning), and the
resulting vectors are shared by all algorithms and trials.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import TrainingError
from tablewright.functions.scalars import quoted
from tablewright.ml.algorithms import (
    CLASSIFICATION,
    TASKS,
    AlgorithmSpec,
    Context,
    available_keys,
    get_algorithm,
)
from tablewright.ml.forest import Forest
from tablewright.ml.knn import NearestNeighbours
from tablewright.operators import metrics as M
from tablewright.operators.features import FeatureConfig, FittedFeatures, fit_features
from tablewright.operators.ordering import hash_numbered
from tablewright.operators.split import (
    assign_folds,
    can_stratify,
    effective_folds,
    feature_schema,
    prepare_target,
    train_test_split,
)

LABEL = "label"
PARTITION_BYTES = 16 << 20
#: Models that are tables, not stages of a pipeline.
OWN_MODELS = {"neighbours": NearestNeighbours, "forest": Forest}
RUN_SCHEMA = (
    "id string, artifact string, experiment_id string, position int, algorithm string, status string, error string, "
    "params map<string,string>, metrics map<string,double>, primary_metric string, "
    "primary_score double, duration_seconds double, feature_schema string, "
    "class_names array<string>"
)


@dataclass(frozen=True)
class TrainingControls:
    """How training is carried out."""

    optimize: bool = False
    n_trials: int = 20
    cv_folds: int = 3
    test_size: float = 0.2
    seed: int = 42
    parallelism: int = 2

    def validate(self) -> None:
        if not 1 <= self.n_trials <= 200:
            raise TrainingError("n_trials must lie between 1 and 200.")
        if not 2 <= self.cv_folds <= 10:
            raise TrainingError("cv_folds must lie between 2 and 10.")
        if not 0 < self.test_size < 0.9:
            raise TrainingError("test_size must lie between 0 and 0.9.")


@dataclass(frozen=True)
class Request:
    """What is to be trained: a checked task with its algorithms and the metric that ranks them."""

    task: str
    algorithms: tuple[str, ...]
    metric: str


def checked_request(task: str, algorithms: list[str] | None = None, metric: str | None = None) -> Request:
    """A request with defaults filled in: every algorithm of the task, and its usual metric.

    All faults are gathered and raised together.
    """
    known, ranked = available_keys(task), M.PRIMARY_METRICS.get(task, ())
    wanted = tuple(algorithms or known)
    chosen = metric or M.DEFAULT_METRIC.get(task)
    faults = {
        f"no such task: {task}": task not in TASKS,
        f"not trainable for {task}: {', '.join(sorted(set(wanted) - set(known)))}": not set(wanted) <= set(known),
        f"{chosen} does not rank {task}": chosen not in ranked,
    }
    found = [text for text, wrong in faults.items() if wrong]
    if found:
        raise TrainingError("; ".join(found))
    return Request(task, wanted, chosen)


def scored_frame(model: Any, vectors: DataFrame, classes: bool) -> DataFrame:
    """Predictions with a ``scores`` array of class probabilities where the model has them."""
    scored = model.transform(vectors)
    if classes and "probability" in scored.columns:
        return scored.withColumn("scores", vector_to_array("probability"))
    return scored


@dataclass
class FittedRun:
    """One trained algorithm with everything needed to score new rows."""

    algorithm: str
    task: str
    target: str
    features: FittedFeatures
    model: Any
    feature_schema: list[dict[str, str]]
    class_names: list[str] | None = None
    params: dict[str, Any] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    primary_metric: str = ""
    primary_score: float | None = None
    duration_seconds: float = 0.0

    @property
    def n_classes(self) -> int:
        return len(self.class_names or [])

    def score(self, df: DataFrame) -> DataFrame:
        """Features, then prediction (class position or number) and class scores."""
        return scored_frame(self.model, self.features.transform(df), self.task == CLASSIFICATION)

    def save(self, path: str) -> None:
        """Write features, model and description below ``path``."""
        self.features.model.write().save(f"{path}/features")
        kind = next((k for k, own in OWN_MODELS.items() if isinstance(self.model, own)), "stages")
        if kind in OWN_MODELS:
            self.model.save(f"{path}/model")
        else:
            PipelineModel([self.model]).write().save(f"{path}/model")
        text = json.dumps(
            {
                "kind": kind,
                "names": self.features.names,
                "numeric": self.features.numeric,
                "categorical": self.features.categorical,
                **{
                    k: getattr(self, k)
                    for k in (
                        "algorithm", "task", "target", "feature_schema", "class_names", "params",
                        "metrics", "primary_metric", "primary_score", "duration_seconds",
                    )
                },
            }
        )
        spark = SparkSession.active()
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedRun:
        """Read what :meth:`save` wrote."""
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        kind = about.pop("kind")
        features = FittedFeatures(
            PipelineModel.load(f"{path}/features"),
            about.pop("numeric"),
            about.pop("categorical"),
            about.pop("names"),
        )
        if kind in OWN_MODELS:
            model = OWN_MODELS[kind].load(spark, f"{path}/model")
        else:
            model = PipelineModel.load(f"{path}/model")
        return cls(features=features, model=model, **about)


@dataclass
class ExperimentResult:
    """Runs as a table, the fitted models by algorithm, and the best one."""

    experiment_id: str
    status: str
    runs: DataFrame
    fitted: dict[str, FittedRun]
    best: FittedRun | None
    test: DataFrame  # the hold-out rows with their label


@dataclass
class _Data:
    """Prepared rows of an experiment: raw train and test rows with ``label``."""

    train: DataFrame
    test: DataFrame
    names: list[str] | None
    schema: list[dict[str, str]]
    config: FeatureConfig


def prepare_data(
    df: DataFrame, target: str, task: str, config: FeatureConfig, controls: TrainingControls,
    key: list[str] | None = None,
) -> _Data:
    """Encode the target and split; ``key`` columns order the rows and are no features."""
    if target not in df.columns:
        raise TrainingError(f"Target column {target!r} not found.")
    prepared, names = prepare_target(df, target, task)
    prepared = prepared.drop(target) if target != LABEL else prepared
    schema = feature_schema(df.drop(*(key or [])), target)
    stratify = LABEL if task == CLASSIFICATION and can_stratify(prepared) else None
    train, test = train_test_split(
        prepared, label=stratify, key=key, seed=controls.seed, test_size=controls.test_size
    )
    return _Data(train, test, names, schema, replace(config, target=None))


def vectors(fitted: FittedFeatures, df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Feature vectors with their label.

    Iterative fits run one job per step, so small sets should not sit in many tiny partitions:
    with ``n_rows``, they are merged up to ``PARTITION_BYTES`` (never split). Trees, neighbours and
    naive Bayes do not depend on the partitions; sums of the other fits differ in their last digits.
    """
    frame = fitted.transform(df).select("features", LABEL)
    if n_rows is None:
        return frame
    size = n_rows * (len(fitted.names) + 1) * 8
    return frame.coalesce(max(1, math.ceil(size / PARTITION_BYTES)))


def tune(
    spec: AlgorithmSpec, train: DataFrame, task: str, config: FeatureConfig, metric: str,
    controls: TrainingControls, n_classes: int = 0, key: list[str] | None = None,
) -> tuple[dict[str, Any], DataFrame]:
    """Best setting of a seeded random search by mean fold score, and all trials as a table.

    Features are refitted inside each fold, so nothing leaks, but only once for all trials.
    """
    spark = train.sparkSession
    stratum = LABEL if task == CLASSIFICATION else None
    folds = effective_folds(train, controls.cv_folds, stratum)
    parted = assign_folds(train, folds=folds, label=stratum, key=key, seed=controls.seed)
    parted = parted.persist(StorageLevel.MEMORY_AND_DISK)
    rng = np.random.default_rng(controls.seed)
    trials = [spec.draw(task, rng) for _ in range(controls.n_trials)]
    scores = np.full((len(trials), folds), np.nan)
    drop = key or []
    for fold in range(folds):
        part = parted.filter(F.col("fold") != fold).drop("fold", *drop)
        rest = parted.filter(F.col("fold") == fold).drop("fold", *drop)
        fitted = fit_features(part, config, LABEL, task)
        n = part.count()
        inside = vectors(fitted, part, n).persist(StorageLevel.MEMORY_AND_DISK)
        outside = vectors(fitted, rest, n).persist(StorageLevel.MEMORY_AND_DISK)
        context = Context(task, n, n_classes, controls.seed)

        def attempt(i, inside=inside, outside=outside, context=context, fold=fold):
            model = spec.fit(inside, context, trials[i])
            scored = scored_frame(model, outside, task == CLASSIFICATION)
            row = M.metric_frame(scored, metric, n_classes).first()
            scores[i, fold] = np.nan if row is None or row["value"] is None else row["value"]

        pool = ThreadPool(max(1, controls.parallelism))
        try:
            pool.map(inheritable_thread_target(spark)(attempt), range(len(trials)))
        finally:
            pool.close()
            inside.unpersist()
            outside.unpersist()
    parted.unpersist()
    means = scores.mean(axis=1)
    table = spark.createDataFrame(
        [
            (i, {k: str(v) for k, v in t.items()}, None if np.isnan(m) else float(m))
            for i, (t, m) in enumerate(zip(trials, means, strict=True))
        ],
        "trial int, params map<string,string>, score double",
    )
    if np.isnan(means).all():
        raise TrainingError("No trial could be scored.")
    return trials[int(np.nanargmax(means))], table


def run_charts(scored: DataFrame, n_classes: int = 0) -> dict[str, DataFrame]:
    """The data of a run's charts: the confusion matrix and, of two classes, the ROC curve; of a number
    the predictions with their residuals, and the ends of the ideal line."""
    if n_classes:
        charts = {"confusion_matrix": M.confusion_matrix(scored, n_classes)}
        if n_classes == 2 and "scores" in scored.columns:
            charts["roc_curve"] = M.roc_curve(scored.withColumn("score", F.get("scores", F.lit(1))))
        return charts
    points = M.residuals(scored.select(F.col(LABEL).cast("double").alias("actual"), F.col("prediction").alias("predicted")), "actual", "predicted")
    return {"residuals": points, "ideal_line": M.ideal_line(scored)}


def load_charts(spark: SparkSession, artifact: str) -> dict[str, DataFrame]:
    """The chart data that is stored with a run's artifact, by name."""
    names = spark.read.text(f"{artifact}/charts/names").collect()  # two at most
    return {r["value"]: spark.read.parquet(f"{artifact}/charts/{r['value']}") for r in names}


def _store_charts(charts: dict[str, DataFrame], artifact: str) -> None:
    for name, chart in charts.items():
        chart.write.parquet(f"{artifact}/charts/{name}")
    names = [(name,) for name in charts]
    SparkSession.active().createDataFrame(names, "value string").coalesce(1).write.text(f"{artifact}/charts/names")


def train_one(
    spec: AlgorithmSpec, data: _Data, task: str, target: str, metric: str,
    controls: TrainingControls, *, fitted: FittedFeatures, inside: DataFrame, outside: DataFrame,
    key: list[str] | None = None, artifact: str | None = None,
) -> FittedRun:
    """Tune if asked, fit on the train part, score the hold-out; with ``artifact``, a folder, store the
    data of the run's charts below it."""
    started = time.perf_counter()
    n_classes = len(data.names or [])
    params: dict[str, Any] = {}
    if controls.optimize and spec.spaces.get(task):
        params, _ = tune(spec, data.train, task, data.config, metric, controls, n_classes, key)
    model = spec.fit(inside, Context(task, inside.count(), n_classes, controls.seed), params)
    scored = scored_frame(model, outside, task == CLASSIFICATION)
    scored = scored.select(*[c for c in (LABEL, "prediction", "scores") if c in scored.columns])
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = M.all_metrics(scored, n_classes)
        if artifact:
            _store_charts(run_charts(scored, n_classes), artifact)
    finally:
        scored.unpersist()
    value = found.get(metric)
    if value is not None and metric in M.ERROR_METRICS:
        value = -value
    return FittedRun(
        spec.key, task, target, fitted, model, data.schema, data.names, params, found, metric,
        value, round(time.perf_counter() - started, 3),
    )


def run_experiment(
    df: DataFrame,
    target: str,
    task: str,
    *,
    algorithms: list[str] | None = None,
    metric: str | None = None,
    config: FeatureConfig | None = None,
    controls: TrainingControls | None = None,
    key: list[str] | None = None,
    experiment_id: str = "experiment",
    artifacts: str | None = None,
) -> ExperimentResult:
    """Train every requested algorithm; a failing one is recorded, not raised.

    With ``artifacts``, a folder, each fitted run is saved below it with the data of its charts, and its
    row names the place, as registering it demands.

    The request is checked before any job runs. The best completed run has the highest score;
    the first one in list order wins ties.
    """
    controls = controls or TrainingControls()
    controls.validate()
    config = config or FeatureConfig()
    config.validate()
    request = checked_request(task, algorithms, metric)
    metric, keys = request.metric, request.algorithms
    data = prepare_data(df, target, task, config, controls, key)
    data.train = data.train.persist(StorageLevel.MEMORY_AND_DISK)
    drop = key or []
    rows, models, kept = [], {}, []
    best: FittedRun | None = None
    try:
        fitted = fit_features(data.train.drop(*drop), data.config, LABEL, task)
        n = data.train.count()
        inside = vectors(fitted, data.train, n).persist(StorageLevel.MEMORY_AND_DISK)
        outside = vectors(fitted, data.test, n).persist(StorageLevel.MEMORY_AND_DISK)
        kept += [inside, outside]
        for position, name in enumerate(keys):
            run_id = f"{experiment_id}-{position}"
            artifact = f"{artifacts.rstrip('/')}/{run_id}" if artifacts else None
            try:
                run = train_one(
                    get_algorithm(name), data, task, target, metric, controls, fitted=fitted,
                    inside=inside, outside=outside, key=key, artifact=artifact,
                )
                if artifact:
                    run.save(artifact)
            except Exception as exc:
                rows.append((run_id, None, experiment_id, position, name, "failed", str(exc), {}, {},
                             metric, None, None, None, None))
                continue
            models[name] = run
            if run.primary_score is not None and (
                best is None or run.primary_score > best.primary_score
            ):
                best = run
            rows.append((
                run_id, artifact, experiment_id, position, name, "completed", None,
                {k: str(v) for k, v in run.params.items()}, run.metrics, metric,
                run.primary_score, run.duration_seconds, json.dumps(run.feature_schema),
                run.class_names,
            ))
    finally:
        data.train.unpersist()
        for frame in kept:
            frame.unpersist()
    runs = df.sparkSession.createDataFrame(rows, RUN_SCHEMA)
    status = "completed" if best else "failed"
    return ExperimentResult(experiment_id, status, runs, models, best, data.test)


def log_runs(runs: DataFrame, path: str) -> None:
    """Append runs to the run table."""
    runs.write.mode("append").parquet(path)


def learning_curve(
    df: DataFrame, target: str, task: str, algorithm: str, *, metric: str | None = None,
    config: FeatureConfig | None = None, params: dict[str, Any] | None = None, folds: int = 3,
    sizes: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), key: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean train and validation score over the folds for growing, nested training sets."""
    metric = checked_request(task, [algorithm], metric).metric
    spec = get_algorithm(algorithm)
    prepared, names = prepare_target(df, target, task)
    prepared = prepared.drop(target) if target != LABEL else prepared
    config = replace(config or FeatureConfig(), target=None)
    stratum = LABEL if task == CLASSIFICATION else None
    parted = assign_folds(
        prepared, folds=effective_folds(prepared, folds, stratum), label=stratum, key=key, seed=seed
    ).persist(StorageLevel.MEMORY_AND_DISK)
    n_folds = parted.agg(F.max("fold").alias("m")).first()["m"] + 1
    n_classes, drop = len(names or []), key or []
    found = []
    for fold in range(n_folds):
        rest = parted.filter(F.col("fold") == fold).drop("fold", *drop)
        ordered = hash_numbered(
            parted.filter(F.col("fold") != fold).drop("fold"), key=key, seed=seed + 1
        ).persist(StorageLevel.MEMORY_AND_DISK)
        for size in sizes:
            part = ordered.filter(
                F.col("_number") < F.ceil(F.col("_total") * F.lit(size))
            ).drop("_number", "_total", *drop)
            fitted = fit_features(part, config, LABEL, task)
            n = part.count()
            inside = vectors(fitted, part, n).persist(StorageLevel.MEMORY_AND_DISK)
            model = spec.fit(inside, Context(task, n, n_classes, seed), params or {})
            values = [
                M.metric_frame(scored_frame(model, frame, bool(n_classes)), metric, n_classes).first()
                for frame in (inside, vectors(fitted, rest, n))
            ]
            found.append((float(size), n, *[v["value"] if v else None for v in values]))
            inside.unpersist()
        ordered.unpersist()
    parted.unpersist()
    table = df.sparkSession.createDataFrame(
        found, "size double, n bigint, train double, validation double"
    )
    return table.groupBy("size").agg(
        F.avg("n").cast("bigint").alias("n_rows"),
        F.avg("train").alias("train_score"),
        F.avg("validation").alias("validation_score"),
    )


def best_model(runs: DataFrame) -> DataFrame:
    """The best run per experiment, from a run table."""
    return M.best_runs(runs)


def run_metrics_long(runs: DataFrame) -> DataFrame:
    """``(experiment_id, algorithm, metric, value)`` rows of a run table."""
    return runs.select("experiment_id", "algorithm", F.explode("metrics").alias("metric", "value"))


def feature_importances(run: FittedRun) -> list[tuple[str, float]]:
    """Impurity importances of a tree model, by feature name; empty for other models."""
    model = run.model
    values = getattr(model, "featureImportances", None)
    if values is None:
        return []
    return list(zip(run.features.names, values.toArray().tolist(), strict=True))


def select_inputs(df: DataFrame, schema: list[dict[str, str]]) -> DataFrame:
    """Only the columns a model needs, so the scan reads no others."""
    return df.select(*[quoted(c["name"]) for c in schema])
