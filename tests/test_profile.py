import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.errors import DataLoadError
from tablewright.functions.scalars import normalise_missing
from tablewright.operators import eda as E
from tablewright.operators import profile as P
from tablewright.operators import quantiles as Q


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (25.0, 40000, "M", True), (30.0, 50000, "F", False), (35.0, 60000, "M", True),
        (float("nan"), 52000, "F", False), (28.0, 45000, "M", True), (200.0, 58000, "F", False),
    ]
    df = spark.createDataFrame(rows, "age double, income bigint, gender string, flag boolean")
    return normalise_missing(df)


def test_schema_and_types(people):
    rows = {r["column"]: r for r in P.column_schema(people).collect()}
    assert [rows[c]["inferred_type"] for c in ("age", "income", "gender", "flag")] == [
        "numeric", "numeric", "categorical", "boolean",
    ]
    assert rows["age"]["n_missing"] == 1 and rows["age"]["missing_pct"] == 16.6667
    assert rows["gender"]["n_unique"] == 2


def test_outlier_and_overview(people):
    age = P.numeric_summary(people).filter("column = 'age'").first()
    assert age["n_outliers"] == 1 and age["count"] == 5
    row = P.overview(people).first()
    assert (row["n_rows"], row["n_columns"], row["missing_cells"]) == (6, 4, 1)
    assert (row["n_numeric"], row["n_categorical"]) == (2, 2)


def test_unique_ids_are_text(spark):
    df = spark.range(100).select(F.concat(F.lit("id-"), "id").alias("c"))
    assert P.column_schema(df).first()["inferred_type"] == "text"


def test_empty_column_is_categorical(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "c string, n int")
    assert P.column_schema(df).filter("column = 'c'").first()["inferred_type"] == "categorical"
    empty = spark.createDataFrame([(None,), (None,)], "x double")
    row = P.numeric_summary(empty).first()
    assert row["count"] == 0 and row["mean"] is None and row["n_zeros"] is None


def test_unsupported_type(spark):
    with pytest.raises(DataLoadError):
        P.column_schema(spark.createDataFrame([([1],)], "a array<int>"))


def test_against_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "a": rng.normal(5, 2, 400),
            "b": rng.integers(0, 9, 400).astype(float),
            "c": np.full(400, 2.5),
            "d": rng.exponential(3, 400),
        }
    )
    frame.loc[::7, "a"] = np.nan
    frame.loc[::5, "d"] = np.nan
    df = normalise_missing(spark.createDataFrame(frame))
    for row in P.numeric_summary(df).collect():
        s = frame[row["column"]].dropna()
        expected = {
            "mean": s.mean(), "std": s.std(), "p25": s.quantile(0.25), "median": s.median(),
            "p75": s.quantile(0.75), "skew": s.skew(), "kurtosis": s.kurt(),
        }
        for name, value in expected.items():
            assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
    correlation = frame.corr()
    for row in P.correlation_matrix(df).collect():
        value = correlation.loc[row["a"], row["b"]]
        if math.isnan(value):
            assert row["correlation"] is None
        else:
            assert row["correlation"] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_rows(spark, n):
    values = [1.0, 5.0, 2.0, 9.0][:n]
    row = P.numeric_summary(spark.createDataFrame([(v,) for v in values], "x double")).first()
    s = pd.Series(values)
    assert row["std"] == pytest.approx(s.std() if n > 1 else 0)
    assert row["skew"] == pytest.approx(s.skew() if n > 2 else 0)
    assert row["kurtosis"] == pytest.approx(s.kurt() if n > 3 else 0)


def test_bracket_quantiles(spark, monkeypatch):
    """The large-table way gives the exact quantiles: skewed, tied and extreme values."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(
        {
            "normal": rng.normal(0, 1, 20_000),
            "tied": rng.choice([1.0, 1.0, 1.0, 2.0, 3.0], 20_000),
            "wide": np.exp(rng.normal(0, 12, 20_000)),
            "gaps": np.where(rng.random(20_000) < 0.3, np.nan, rng.integers(0, 50_000, 20_000)),
            "empty": np.nan,
        }
    )
    df = normalise_missing(spark.createDataFrame(frame).repartition(5))
    monkeypatch.setattr(Q, "BRACKET_ROWS", 20)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = Q.exact_quantiles(df, list(frame.columns), probabilities)
    for name in frame.columns:
        expected = frame[name].quantile(probabilities).tolist()
        if name == "empty":
            assert found[name] == [None] * len(probabilities)
        else:
            assert found[name] == pytest.approx(expected, rel=1e-12), name


def test_bracket_recovers_from_a_wrong_sketch(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(Q, "BRACKET_ROWS", 10)
    for low, high in ((4000.0, 4500.0), (0.0, 100.0)):
        b = Q._Bracket("x", 2000, -math.inf, math.inf, 0, 5000)
        Q._recount(df, [b], [(low, high, 0.0, 4999.0)])
        assert Q.order_statistics(df, [b])["x", 2000] == 2000.0


def test_boolean_top_values(people):
    rows = P.top_values(people, ["flag", "gender"]).orderBy("column", "rank").collect()
    assert [(r["value"], r["count"], r["pct"]) for r in rows] == [
        ("False", 3, 50.0), ("True", 3, 50.0), ("F", 3, 50.0), ("M", 3, 50.0),
    ]


def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "a int, b string")
    assert P.duplicate_rows(df).first()[0] == 3
    assert [tuple(r) for r in P.missing_by_column(df).collect()] == [("b", 2)]


def test_chart_bundle(people):
    charts = E.chart_data(people, bins=4)
    assert charts.histograms.filter("column = 'age'").agg(F.sum("count")).first()[0] == 5
    assert {r["column"] for r in charts.categories.collect()} == {"gender", "flag"}
    assert charts.correlations.count() == 4
    assert charts.scatter.count() == 5


def test_same_result_for_any_partitioning(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 13).alias("y")
    )
    answers = []
    for parts in (1, 4, 50):
        d = df.repartition(parts)
        answers.append(
            (
                [tuple(r) for r in P.top_values(d, ["y"]).orderBy("rank").collect()],
                sorted(tuple(r) for r in E.scatter_sample(d, "x", "y", key=["id"], points=20).collect()),
            )
        )
    assert answers[0] == answers[1] == answers[2]


def test_approximate_options(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    row = P.numeric_summary(df, accuracy=1000).first()
    assert row["median"] == pytest.approx(10_000, rel=0.01)
    n = P.column_schema(df, rsd=0.02).first()["n_unique"]
    assert n == pytest.approx(20_000, rel=0.1)
