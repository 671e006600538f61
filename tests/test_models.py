import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import tablewright.ml.knn as knn
from tablewright.errors import ScoringError, TrainingError
from tablewright.ml import algorithms as A
from tablewright.ml import insensitive
from tablewright.ml.forest import Forest
from tablewright.ml.knn import NearestNeighbours
from tablewright.operators import explain as X
from tablewright.operators import metrics as M
from tablewright.operators.features import FeatureConfig, fit_features
from tablewright.plans import automl, registry, scoring
from tablewright.streaming.score import score_stream


def blobs(spark, n=60, seed=42):
    """Two clouds around (2, 1) and (-2, -1); x3 is noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        side = 1 if i % 2 else -1
        x = rng.normal([2 * side, side, 0], 0.5)
        rows.append((i, *map(float, x), "yes" if side == 1 else "no"))
    return spark.createDataFrame(rows, "id bigint, x1 double, x2 double, x3 double, target string")


@pytest.fixture(scope="module")
def two_blobs(spark):
    return blobs(spark).cache()


@pytest.fixture(scope="module")
def experiment(two_blobs):
    return automl.run_experiment(
        two_blobs, "target", "classification", algorithms=["logistic_regression", "knn"],
        metric="accuracy", key=["id"],
    )


def test_experiment(experiment):
    rows = {r["algorithm"]: r for r in experiment.runs.collect()}
    assert experiment.status == "completed" and experiment.best.algorithm == "logistic_regression"
    for row in rows.values():
        assert row["status"] == "completed" and row["metrics"]["accuracy"] > 0.9
        assert row["class_names"] == ["no", "yes"]
    assert [c["name"] for c in experiment.best.feature_schema] == ["x1", "x2", "x3"]


def test_failures_are_recorded(two_blobs):
    def broken(df, context, params):
        raise RuntimeError("no luck")

    A.register_algorithm(A.AlgorithmSpec("broken", "Broken", A.TASKS, broken))
    try:
        result = automl.run_experiment(
            two_blobs, "target", "classification", algorithms=["broken"], key=["id"]
        )
    finally:
        A._REGISTRY.pop("broken")
    row = result.runs.first()
    assert result.status == "failed" and row["status"] == "failed" and "no luck" in row["error"]


@pytest.mark.parametrize(
    "change",
    [
        {"algorithms": ["magic"]}, {"target": "nothing"}, {"task": "clustering"},
        {"metric": "rmse"}, {"controls": automl.TrainingControls(n_trials=0)},
        {"controls": automl.TrainingControls(cv_folds=11)},
        {"controls": automl.TrainingControls(test_size=0.95)},
    ],
)
def test_bad_requests(two_blobs, change):
    request = {"target": "target", "task": "classification", **change}
    with pytest.raises(TrainingError):
        automl.run_experiment(two_blobs, request.pop("target"), request.pop("task"), **request)


def test_single_class(two_blobs):
    with pytest.raises(TrainingError):
        automl.run_experiment(two_blobs.filter("target = 'yes'"), "target", "classification")


def test_tuning(two_blobs):
    controls = automl.TrainingControls(optimize=True, n_trials=3, cv_folds=2)
    result = automl.run_experiment(
        two_blobs, "target", "classification", algorithms=["knn"], controls=controls,
        metric="accuracy", key=["id"],
    )
    assert set(result.best.params) == {"n_neighbors", "weights"}
    assert result.best.metrics["accuracy"] > 0.9


def test_predictions_and_round_trip(spark, experiment, tmp_path):
    records = spark.createDataFrame(
        [(2.0, 1.0, 0.0, "a"), (-2.0, -1.0, None, "b")], "x1 double, x2 double, x3 double, tag string"
    )
    for name, run in experiment.fitted.items():
        before = scoring.predict(run, records, keep=["tag"]).orderBy("tag").collect()
        assert [r["prediction"] for r in before] == ["yes", "no"]
        assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in before)
        path = str(tmp_path / name)
        run.save(path)
        again = automl.FittedRun.load(spark, path)
        after = scoring.predict(again, records, keep=["tag"]).orderBy("tag").collect()
        assert before == after and again.metrics == run.metrics


def test_missing_feature_and_json(spark, experiment):
    run = experiment.best
    with pytest.raises(ScoringError, match="x3"):
        scoring.predict(run, spark.createDataFrame([(1.0, 2.0)], "x1 double, x2 double"))
    texts = [('{"x1": "2", "x2": 1, "x3": "zero", "extra": 5}',), ('{"x1": -2, "x2": -1, "x3": null}',)]
    scored = scoring.predict_json(run, spark.createDataFrame(texts, "r string"), "r")
    assert [r["prediction"] for r in scored.collect()] == ["yes", "no"]
    with pytest.raises(ScoringError):
        scoring.predict_json(run, spark.createDataFrame([('{"x1": 1}',)], "r string"), "r")


def test_stream(spark, experiment, tmp_path):
    blobs(spark, 20, 7).drop("target").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, x1 double, x2 double, x3 double").parquet(str(tmp_path / "in"))
    query = score_stream(experiment.best, stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"])
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_importances(experiment):
    run = experiment.best
    rows = {r["feature"]: r for r in X.permutation_importance(run, experiment.test, key=["id"]).collect()}
    assert set(rows) == {"x1", "x2", "x3"}
    assert rows["x1"]["importance"] + rows["x2"]["importance"] > rows["x3"]["importance"]
    shap = {r["feature"]: r["importance"] for r in X.shapley_importance(run, experiment.test, key=["id"]).collect()}
    assert shap["numeric__x1"] > shap["numeric__x3"]
    curve = X.partial_dependence(run, experiment.test, "x1", points=3).orderBy("value").collect()
    assert curve[0]["mean_output"] < curve[-1]["mean_output"]


def test_shapley_values_add_up(spark):
    """For a linear model the exact value of feature i is w_i (x_i - z_i), whatever the order."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 2))
    y = 3 * x[:, 0] - 1 * x[:, 1]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                               "id bigint, a double, b double, y double")
    result = automl.run_experiment(df, "y", "regression", algorithms=["logistic_regression"], key=["id"])
    shap = {r["feature"]: r["importance"]
            for r in X.shapley_importance(result.best, df.withColumnRenamed("y", "label"), key=["id"], draws=20).collect()}
    assert shap["numeric__a"] / shap["numeric__b"] == pytest.approx(3, rel=0.25)


@pytest.mark.parametrize("key", A.available_keys("classification"))
def test_classifiers(two_blobs, key):
    prepared = two_blobs.withColumn("label", (F.col("target") == "yes").cast("double")).drop("target", "id")
    frame = fit_features(prepared, FeatureConfig(), "label").transform(prepared).coalesce(1).cache()
    small = {"n_estimators": 10, "max_depth": 3}
    params = small if key in ("random_forest", "extra_trees", "gradient_boosting") else {}
    model = A.get_algorithm(key).fit(frame, A.Context("classification", 60, 2), params)
    found = M.all_metrics(automl.scored_frame(model, frame, True), 2)
    assert found["accuracy"] > 0.9 and found["roc_auc"] > 0.9


@pytest.mark.parametrize("key", A.available_keys("regression"))
def test_regressors(spark, key):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (120, 2))
    y = 2 * x[:, 0] + x[:, 1] + 1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, label double")
    frame = fit_features(df, FeatureConfig(), "label").transform(df).coalesce(1).cache()
    params = {"n_estimators": 30, "max_depth": 6} if key in ("random_forest", "extra_trees", "gradient_boosting") else {}
    model = A.get_algorithm(key).fit(frame, A.Context("regression", 120), params)
    assert M.regression_metrics(model.transform(frame)).first()["r2"] > 0.8


def _vectors(spark, x, y):
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, label double")
    return df.select(array_to_vector("x").alias("features"), "label").coalesce(1).cache()


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_extra_trees_on_a_long_tail(spark, tmp_path, task):
    """Nearly all rows lie below most thresholds that are uniform over the whole range: it is the ranges of
    the nodes below that tell them apart, so trees grow deep."""
    x = np.exp(np.random.default_rng(3).normal(0, 4, (300, 1)))
    x[0] = 1e9
    y = x[:, 0] > 1
    frame = _vectors(spark, x, y)
    model = A.get_algorithm("extra_trees").fit(frame, A.Context(task, 300, 2), {"n_estimators": 15})
    found = model.transform(frame).select("label", "prediction").collect()
    assert np.mean([(r.prediction > 0.5) == (r.label > 0.5) for r in found]) > 0.95
    model.save(f"{tmp_path}/model")
    again = Forest.load(spark, f"{tmp_path}/model")
    assert again.transform(frame).select("label", "prediction").collect() == found


def test_trees_grow_below_ten_levels(spark):
    """Each split takes one row from the rest: twenty in turn until all leaves are pure."""
    frame = _vectors(spark, np.eye(40), np.arange(40) % 2)
    model = A.get_algorithm("decision_tree").fit(frame, A.Context("classification", 40, 2), {})
    assert model.transform(frame).filter("label <> prediction").count() == 0


def test_three_classes_by_one_vs_rest(spark):
    rng = np.random.default_rng(4)
    centres = [(0, 3), (3, 0), (-3, -3)]
    rows = [(*map(float, rng.normal(centres[i % 3], 0.4)), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    frame = fit_features(df, FeatureConfig(), "label").transform(df).coalesce(1).cache()
    for key, params in (("gradient_boosting", {"n_estimators": 3}), ("svm", {"kernel": "linear"})):
        model = A.get_algorithm(key).fit(frame, A.Context("classification", 60, 3), params)
        found = M.all_metrics(automl.scored_frame(model, frame, True), 3)
        assert found["accuracy"] > 0.9 and found["roc_auc"] > 0.9


@pytest.mark.parametrize("weighting", ["uniform", "distance"])
@pytest.mark.parametrize("n_classes", [0, 3])
def test_neighbours_equal_all_distances(spark, tmp_path, monkeypatch, weighting, n_classes):
    """Many copies of one training row, small blocks and chunks, ties: as if all were compared."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (150, 3)), 1)
    x[:50] = x[0]
    frame = _vectors(spark, x, np.arange(150) % 3)
    for name, value in (("BLOCK_ROWS", 12), ("QUERY_ROWS", 10)):
        monkeypatch.setattr(knn, name, value)
    asked = np.r_[x[45:90], np.round(rng.normal(0, 2, (30, 3)), 1)]
    questions = _vectors(spark, asked, np.arange(len(asked)))
    for k in (4, 500) if weighting == "distance" and n_classes else (60,):
        model = NearestNeighbours.fit(frame, k=k, weighting=weighting, n_classes=n_classes)
        found = {r.label: r for r in model.transform(questions).collect()}
        for i, q in enumerate(asked):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            near = np.lexsort((np.arange(150) % 3, d))[:k]
            votes = np.ones(len(near))
            if weighting == "distance":
                votes = (d[near] == 0).astype(float) if (d[near] == 0).any() else 1 / d[near]
            if n_classes:
                shares = np.bincount(near % 3, votes, 3) / votes.sum()
                assert np.allclose(found[i].probability.toArray(), shares)
            else:
                assert np.isclose(found[i].prediction, np.average(near % 3, weights=votes))
    model.save(f"{tmp_path}/model")
    again = NearestNeighbours.load(spark, f"{tmp_path}/model").transform(questions).select("label", "prediction")
    assert sorted(again.collect()) == sorted((r.label, r.prediction) for r in found.values())


def test_neighbours_visit_few_blocks_of_clustered_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.uniform(-100, 100, (40, 4))
    frame = _vectors(spark, centres[np.arange(4000) % 40] + rng.normal(0, 1, (4000, 4)), np.zeros(4000))
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    model = NearestNeighbours.fit(frame, k=5)
    assert len(model.pivots) == 63
    visits = model.visited_blocks(frame).agg(F.avg("first").alias("first"), F.avg("second").alias("second")).first()
    assert len(model.blocks) > 100 and visits["first"] < 1.5 and visits["second"] < 0.1 * len(model.blocks)


def test_stream_of_neighbours(spark, experiment, tmp_path):
    blobs(spark, 20, 7).drop("target").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, x1 double, x2 double, x3 double").parquet(str(tmp_path / "in"))
    query = score_stream(experiment.fitted["knn"], stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"])
    query.awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, [1, 5], (80, 2))
    y = x @ [2.0, -1.0] + rng.normal(0, 1, 80)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, label double")
    frame = fit_features(df, FeatureConfig(scaling="none"), "label").transform(df)
    model = A.get_algorithm("logistic_regression").fit(frame, A.Context("regression", 80), {"alpha": 7.0})
    c = x - x.mean(0)
    assert np.allclose(model.coefficients, np.linalg.solve(c.T @ c + 7 * np.eye(2), c.T @ (y - y.mean())))


def test_metrics_by_hand(spark):
    rows = [(0, 0, 0.1), (1, 1, 0.9), (0, 0, 0.2), (1, 0, 0.4), (1, 1, 0.8), (0, 0, 0.3)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    assert M.classification_metrics(df).first()["accuracy"] == pytest.approx(5 / 6)
    assert M.roc_auc(df).first()["roc_auc"] == 1.0
    reg = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.8)], "label double, prediction double")
    assert M.regression_metrics(reg).first()["r2"] == pytest.approx(0.98)
    one = M.roc_auc(df.filter("label = 1")).first()
    assert one["roc_auc"] is None


def test_learning_curve(two_blobs):
    rows = automl.learning_curve(
        two_blobs, "target", "classification", "decision_tree", metric="accuracy", folds=2,
        sizes=(0.5, 1.0), key=["id"],
    ).orderBy("size").collect()
    assert [r["n_rows"] for r in rows] == [15, 30] and rows[-1]["validation_score"] > 0.8


def test_train_register_predict(spark, tmp_path):
    """A logged run with its artifact is registered, loaded from there, and scores new rows."""
    rows = [(i, float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(140)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    result = automl.run_experiment(
        df, "y", "classification", algorithms=["decision_tree", "naive_bayes"], key=["id"],
        experiment_id="e1", artifacts=f"{tmp_path}/artifacts",
    )
    automl.log_runs(result.runs, f"{tmp_path}/runs")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    best = result.runs.orderBy(F.desc("primary_score"), "position").first()
    requests = spark.createDataFrame([(best["id"], "My model", 1.0)], "run_id string, name string, requested_at double")
    experiments = spark.createDataFrame(
        [("e1", 7, "classification", "y", "accuracy")],
        "id string, project_id int, task string, target_column string, primary_metric string",
    )
    models = spark.createDataFrame([(7, "my-model", 4)], "project_id int, slug string, version int")
    made = registry.register_models(requests, runs, experiments, models).first()
    assert (made["slug"], made["version"], made["artifact"]) == ("my-model", 5, best["artifact"])
    loaded = automl.FittedRun.load(spark, made["artifact"])
    new = spark.createDataFrame([(1, 6.0, 0.0), (2, 1.0, 1.0)], "id int, a double, b double")
    found = {r["id"]: r["prediction"] for r in scoring.predict(loaded, new, keep=["id"]).collect()}
    assert {k: str(v) for k, v in found.items()} == {1: "1", 2: "0"}


def test_request_faults_come_together():
    with pytest.raises(TrainingError) as error:
        automl.checked_request("classification", ["nothing"], "rmse")
    assert "nothing" in str(error.value) and "rmse" in str(error.value)
    assert automl.checked_request("regression").metric


def test_bayes_smoothing(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, [1, 30], (90, 2)), np.arange(90) % 3
    x[y == 1, 0] = 2.0  # no spread in one class
    frame = _vectors(spark, x, y)
    for smoothing in (1e-9, 0.5):
        model = A.get_algorithm("naive_bayes").fit(frame, A.Context("classification", 90, 4), {"var_smoothing": smoothing})
        added = smoothing * x.var(axis=0).max()
        logs = []
        for c in range(3):
            m, v = x[y == c].mean(axis=0), x[y == c].var(axis=0) + added
            logs.append(np.log(1 / 3) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1))
        shares = np.exp(logs - np.max(logs, axis=0))
        shares = (shares / shares.sum(axis=0)).T
        got = sorted(((tuple(r.features.toArray()), r.probability.toArray()) for r in model.transform(frame).collect()), key=lambda r: r[0])
        want = sorted(zip(map(tuple, x), shares, strict=True), key=lambda r: r[0])
        assert all(np.allclose(a[1][:3], b[1]) and a[1][3] == 0 for a, b in zip(got, want, strict=True))
    drawn = A.get_algorithm("naive_bayes").draw("classification", np.random.default_rng(1))
    assert 1e-11 <= drawn["var_smoothing"] <= 1e-6


@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_insensitive_regression_beats_other_weights(spark, kernel):
    """No weights near the solution, and none of a coarse search, have a lower objective."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (300, 1))
    y = 2 * x[:, 0] + 1 + rng.standard_t(2, 300)
    model = A.get_algorithm("svm").fit(_vectors(spark, x, y), A.Context("regression", 300), {"kernel": kernel, "C": 0.5})
    scores = next(s for s in model.stages if hasattr(s, "intercept"))
    w, b = np.array(scores.getOrDefault("weights")), scores.getOrDefault("intercept")
    waves = insensitive._waves(model.stages[0] if kernel == "rbf" else None)(x)[:, :-1]

    def objective(w, b):
        return 0.5 * w @ w + 0.5 * np.maximum(0, np.abs(y - waves @ w - b) - 0.1).sum()

    found = objective(w, b)
    for _ in range(300):
        size = 10 ** rng.uniform(-3, 0)
        assert found <= objective(w + rng.normal(0, size, len(w)), b + rng.normal(0, size)) * (1 + 1e-3)
    if kernel == "linear":
        grid = [objective(np.array([u]), v) for u in np.linspace(0, 4, 161) for v in np.linspace(-1, 3, 161)]
        assert found <= min(grid) * (1 + 1e-3)
    constant = _vectors(spark, x, np.full(300, 3.0))
    same = A.get_algorithm("svm").fit(constant, A.Context("regression", 300), {"kernel": kernel}).transform(constant)
    assert same.filter("abs(prediction - 3) > 1e-6").count() == 0


def test_pairs_ruled_out_by_a_product_are_farther(spark):
    """Far from the origin, with ties and copies: the same neighbours as by all differences."""
    rng = np.random.default_rng(11)
    for shift in (0.0, 1e6):
        points = rng.normal(size=(300, 3)).round(1) + shift
        queries = np.r_[points[:50], rng.normal(size=(50, 3)).round(1) + shift]
        labels, weights = rng.normal(size=300).round(1), rng.integers(1, 3, 300)
        full = knn._distances(queries, points)
        limit = np.where(np.arange(100) % 2, np.inf, np.sort(full, axis=1)[:, 3])
        row, column, copies = knn.nearest_copies(full, limit, labels, weights, 5)
        r, c, d = knn._near_pairs(queries, points, limit, 5)
        within = d <= limit[r]
        found = knn._kept_copies(r[within], c[within], d[within], labels, weights, 5)
        assert shift or len(r) < full.size / 5  # far from the origin rounding leaves more to measure
        for q in range(100):
            want, got = row == q, found[0] == q
            assert np.allclose(full[q, column[want]], found[2][got]) and np.array_equal(copies[want], found[3][got])
        cell, reach = knn._nearest_pivot(queries, points)
        assert np.allclose(reach, full.min(axis=1)) and np.array_equal(cell, full.argmin(axis=1))


def test_large_tables_are_boosted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 100)
    df = spark.range(1000).coalesce(1)
    assert A._spread_rows(df, 1000).rdd.getNumPartitions() == 10 and A._spread_rows(df, 100) is df


def test_rows_are_summed_few_at_a_time(spark):
    """A whole batch is never expanded into Fourier features at once."""
    df = spark.createDataFrame([(([1.0]), 2.0)] * 5000, "x array<double>, y double").coalesce(1)
    most = insensitive._added(df, lambda x, y: np.array([float(len(y) > 1000), float(len(y))]))
    assert most.tolist() == [0.0, 5000.0]


def test_numbers_are_boosted_on_cells(spark, monkeypatch, tmp_path):
    """Trees are grown from rows packed by their bins, and are those that Spark grows from the rows."""
    from pyspark.ml.regression import GBTRegressionModel, GBTRegressor

    rng = np.random.default_rng(8)
    rows = [
        (float(a), float(b), "abc"[c], float(np.sin(a / 9) * 5 + b * c + e))
        for a, b, c, e in zip(rng.integers(0, 100, 3000), rng.integers(0, 5, 3000), rng.integers(0, 3, 3000), rng.normal(0, 1, 3000), strict=True)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c string, label double")
    frame = fit_features(df, FeatureConfig(), "label").transform(df).select("features", "label").coalesce(1).cache()
    same = frame.select(F.lit(0).alias("i"), "features").limit(1).join(frame.select(F.lit(0).alias("i"), "label"), "i").drop("i")
    settings = {"maxIter": 6, "stepSize": 0.1, "maxDepth": 3, "seed": 42}
    plain, flat = GBTRegressor(**settings).fit(frame), GBTRegressor(**settings).fit(same)
    sizes, fit = [], GBTRegressor._fit

    def watched(self, dataset):
        sizes.append(dataset.count())
        return fit(self, dataset)

    monkeypatch.setattr(GBTRegressor, "_fit", watched)
    model = A.get_algorithm("gradient_boosting").fit(frame, A.Context("regression", 3000), {"n_estimators": 6})
    assert len(sizes) == 1 and sizes[0] <= 33 * 5 * 3
    model.save(f"{tmp_path}/model")
    both = frame
    for name, trees in (("p0", plain), ("p1", model), ("p2", GBTRegressionModel.load(f"{tmp_path}/model"))):
        both = trees.transform(both).withColumnRenamed("prediction", name)
    found = np.array([r[:] for r in both.select("p0", "p1", "p2").collect()])
    assert np.allclose(found[:, 1], found[:, 0], rtol=1e-9) and np.array_equal(found[:, 1], found[:, 2])
    assert len(np.unique(found[:, 0])) > 20
    assert np.allclose(model.featureImportances.toArray(), plain.featureImportances.toArray(), rtol=1e-6)
    # rows that are alike in all features: one cell
    model = A.get_algorithm("gradient_boosting").fit(same, A.Context("regression", 3000), {"n_estimators": 6})
    assert np.allclose(model.transform(same).first()["prediction"], flat.transform(same).first()["prediction"], rtol=1e-9)


def test_neighbours_keep_what_can_win(spark):
    """Of rows alike in all features only the k with the smallest labels are placed; all else is as before."""
    rng = np.random.default_rng(10)
    x = rng.integers(0, 5, (3000, 2)).astype(float)
    x[x == 0] = rng.choice([0.0, -0.0], int((x == 0).sum()))
    y = np.round(rng.normal(0, 3, 3000), 1)
    few = rng.uniform(0, 5, (4, 2))  # fewer copies than k
    x, y = np.r_[x, few], np.r_[y, np.arange(4.0)]
    model = NearestNeighbours.fit(_vectors(spark, x, y).repartition(5), k=7)
    kept = model.points.groupBy("x").agg(F.sum("w").alias("w")).collect()
    assert len(kept) == 25 + 4 and sorted(r.w for r in kept) == [1] * 4 + [7] * 25
    assert len(model.pivots) == 5 and len(np.unique(model.pivots, axis=0)) == 5
    asked = np.r_[x[:20], few, rng.uniform(-1, 6, (30, 2))]
    for r in model.transform(_vectors(spark, asked, np.arange(len(asked)))).collect():
        d = np.sqrt(((x - asked[int(r.label)]) ** 2).sum(axis=1))
        assert np.isclose(r.prediction, y[np.lexsort((y, d))[:7]].mean())
