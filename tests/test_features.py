import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.errors import FeatureConfigError
from tablewright.operators import features as X
from tablewright.operators.features import FeatureConfig, Imputation


@pytest.fixture(scope="module")
def churn(spark):
    rows = [
        (25.0, 40000, "M", 0), (30.0, 50000, "F", 1), (float("nan"), 60000, "M", 0),
        (40.0, 52000, "F", 1), (28.0, 45000, "M", 0), (50.0, 58000, None, 1),
        (33.0, 61000, "F", 0), (41.0, 39000, "M", 1),
    ]
    return spark.createDataFrame(rows, "age double, income bigint, gender string, churned int")


def matrix(fitted, df):
    rows = fitted.transform(df).select(vector_to_array("features").alias("f")).collect()
    return np.array([r["f"] for r in rows])


def test_column_split(churn):
    assert X.split_feature_columns(churn, "churned") == (["age", "income"], ["gender"])


def test_dates_are_left_out(churn):
    dated = churn.withColumn("day", F.current_date())
    assert "day" not in sum(X.split_feature_columns(dated, "churned"), [])


def test_onehot_width_and_no_missing(churn):
    fitted = X.fit_features(churn, FeatureConfig(target="churned"))
    values = matrix(fitted, churn)
    assert values.shape == (8, 4) and not np.isnan(values).any()
    assert fitted.names == [
        "numeric__age", "numeric__income", "categorical__gender_F", "categorical__gender_M",
    ]
    assert np.allclose(values[:, :2].mean(axis=0), 0) and np.allclose(values[:, :2].std(axis=0), 1)


def test_pca_width_and_signs(churn):
    config = FeatureConfig(target="churned", pca_enabled=True, pca_components=2)
    fitted = X.fit_features(churn, config)
    assert fitted.names == ["pca0", "pca1"]
    plain = matrix(X.fit_features(churn, FeatureConfig(target="churned")), churn)
    centred = plain - plain.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    assert np.allclose(matrix(fitted, churn), (centred @ (vt * signs[:, None]).T)[:, :2])


def test_pca_by_share(churn):
    config = FeatureConfig(target="churned", pca_enabled=True, pca_components=0.6)
    assert 1 <= len(X.fit_features(churn, config).names) < 4


def test_kbest_width(churn):
    config = FeatureConfig(target="churned", selection_method="kbest", selection_k=2)
    assert len(X.preview_features(churn, config).output_features) == 2


def test_preview(churn):
    preview = X.preview_features(churn, FeatureConfig(target="churned"), ["income"])
    assert (preview.n_features_in, preview.n_features_out) == (3, 4)
    assert preview.sample.count() == 8


@pytest.mark.parametrize(
    "config",
    [
        FeatureConfig(scaling="log"), FeatureConfig(encoding="hash"),
        FeatureConfig(selection_method="lasso"), FeatureConfig(selection_k=0),
        FeatureConfig(imputation=Imputation(numeric_strategy="zero")),
        FeatureConfig(imputation=Imputation(categorical_strategy="mean")),
    ],
)
def test_invalid_settings(churn, config):
    with pytest.raises(FeatureConfigError):
        X.fit_features(churn, config)


def test_no_features(churn):
    with pytest.raises(FeatureConfigError):
        X.fit_features(churn.select("churned"), FeatureConfig(target="churned"))


def test_config_from_plain_values():
    config = FeatureConfig.from_dict({"scaling": "robust", "imputation": {"numeric_strategy": "mean"}})
    assert config.scaling == "robust" and config.imputation.numeric_strategy == "mean"
    with pytest.raises(FeatureConfigError):
        FeatureConfig.from_dict({"speed": 1})


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "flat double, x double")
    for scaling in ("standard", "minmax", "robust"):
        assert (matrix(X.fit_features(df, FeatureConfig(scaling=scaling)), df)[:, 0] == 0).all()


def test_odd_names_and_values(spark):
    df = spark.createDataFrame(
        [(1.0, "it's"), (2.0, "a\\b"), (None, "it's")], "`a.b c` double, `d``e` string"
    )
    fitted = X.fit_features(df, FeatureConfig())
    assert matrix(fitted, df).shape == (3, 3)


def test_booleans_and_unknown_values(spark):
    df = spark.createDataFrame([(True, "x"), (False, "y"), (True, "x")], "b boolean, c string")
    fitted = X.fit_features(df, FeatureConfig(encoding="ordinal"))
    new = spark.createDataFrame([(None, "z"), (False, "x")], "b boolean, c string")
    assert matrix(fitted, new).tolist() == [[1.0, -1.0], [0.0, 0.0]]


def test_scores_against_formulas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 3, (200, 3))
    x[:, 2] = 5.0
    c = rng.integers(0, 3, 200)
    x[:, 0] += c
    y = x[:, 1] * 2 + rng.normal(0, 1, 200)
    df = spark.createDataFrame(
        [(Vectors.dense(r), float(k), float(t)) for r, k, t in zip(x, c, y, strict=True)],
        ["v", "c", "y"],
    )
    groups = [x[c == k] for k in range(3)]
    between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups) / 2
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / 197
    found = X.anova_f(df, "v", "c")
    assert np.allclose(found[:2], (between / np.where(within > 0, within, 1))[:2])
    assert np.isnan(found[2])
    r = np.array([pd.Series(x[:, i]).corr(pd.Series(y)) for i in (0, 1)])
    found = X.f_regression(df, "v", "y")
    assert np.allclose(found[:2], r**2 / (1 - r**2) * 198) and found[2] == 0


def test_pca_of_wide_onehot_features(spark, monkeypatch):
    """A block narrower than the vectors finds the leading directions of sparse columns."""
    from tablewright.ml import principal

    rng = np.random.default_rng(3)
    group = rng.integers(0, 4, 3000)
    values = [(f"a{g}_{rng.integers(0, 3 + 12 * g)}", f"b{g % 2}_{rng.integers(0, 40)}") for g in group]
    df = spark.createDataFrame(values, "a string, b string").repartition(4)
    plain = X.fit_features(df, FeatureConfig())
    x = matrix(plain, df)
    centred = x - x.mean(axis=0)
    variances = np.linalg.eigvalsh(centred.T @ centred / (len(x) - 1))[::-1]
    assert x.shape[1] > 100
    vectors = plain.transform(df)
    directions, found = principal.principal_directions(vectors, "features", 5)
    assert np.allclose(found, variances[:5], rtol=1e-6)
    projected = centred @ directions
    assert np.allclose(projected.var(axis=0, ddof=1), variances[:5], rtol=1e-6)
    monkeypatch.setattr(principal, "FIRST_BLOCK", 4)
    for share in (0.3,):
        directions, found = principal.principal_directions(vectors, "features", None, share)
        wanted = int((np.cumsum(variances) > share * variances.sum()).argmax()) + 1
        assert len(found) == wanted and np.allclose(found, variances[:wanted], rtol=1e-5)
    fitted = X.fit_features(df, FeatureConfig(pca_enabled=True, pca_components=3))
    assert np.allclose(matrix(fitted, df).mean(axis=0), 0)


def test_pca_saves_with_its_pipeline(spark, churn, tmp_path):
    from pyspark.ml import PipelineModel

    fitted = X.fit_features(churn, FeatureConfig(target="churned", pca_enabled=True, pca_components=2))
    fitted.model.write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(churn).select(vector_to_array("features").alias("f")).collect()
    assert np.allclose(np.array([r["f"] for r in again]), matrix(fitted, churn))


def test_numbers_of_categories(spark, monkeypatch):
    from tablewright.operators import categories as K

    values = [f"v{i * 7919 % 500:03d}" if i % 9 else None for i in range(900)]
    rows = [(i, v, bool(i % 2), float(i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "`k 1` int, `a.b` string, flag boolean, _value double").repartition(7)
    known = sorted({v for v in values if v})
    for most in (0, 10_000):
        monkeypatch.setattr(K, "BROADCAST_VALUES", most)
        numbers = K.CategoryNumbers.fit(df.drop("_value"), ["a.b", "flag"])
        assert numbers.sizes == [len(known), 2]
        found = {r["k 1"]: r["hot"] for r in numbers.onehot(df.drop("_value")).collect()}
        assert found == {i: [known.index(v)] * bool(v) + [len(known) + f] for i, v, f, _ in rows}
        new = spark.createDataFrame([("nothing", None), (known[3], True)], "`a.b` string, flag boolean")
        assert [tuple(r)[2:] for r in numbers.ordinal(new).collect()] == [(-1, -1), (3, 1)]
    names = {r["index"]: r["name"] for r in numbers.names().collect()}
    assert names[0] == f"categorical__a.b_{known[0]}" and names[len(known) + 1] == "categorical__flag_True"
    empty = K.CategoryNumbers.fit(df.limit(0).drop("_value"), ["a.b"])
    assert empty.sizes == [0] and empty.onehot(df.drop("_value")).filter(F.size("hot") > 0).count() == 0


def test_texts_are_folded_few_at_a_time():
    import pyarrow as pa
    from tablewright.functions import scalars

    texts = [None, "", "Änne ﬁ ½", "日本 x", "plain"] * 200
    found = scalars._fold_to_ascii.func(pa.array(texts, pa.string()))
    assert found.to_pylist() == [None, "", "Anne fi 12", " x", "plain"] * 200 and found.type == pa.string()
    assert scalars._fold_to_ascii.func(pa.array([], pa.string())).to_pylist() == []
