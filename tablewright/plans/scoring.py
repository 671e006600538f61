"""Batch scoring: schema check, coercion, prediction with class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import ScoringError
from tablewright.functions.scalars import decode_label, numeric_or_null, quoted
from tablewright.ml.algorithms import CLASSIFICATION
from tablewright.plans.automl import FittedRun

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def missing_features(columns: list[str], schema: list[dict[str, str]]) -> list[str]:
    """Required features that are not there."""
    return [c["name"] for c in schema if c["name"] not in columns]


def check_schema(df: DataFrame, schema: list[dict[str, str]]) -> None:
    """Every feature must be present (NULL values are fine, extra columns are ignored)."""
    if not schema:
        raise ScoringError("The model has no feature schema to check against.")
    missing = missing_features(df.columns, schema)
    if missing:
        raise ScoringError(f"The rows miss required features: {missing}.")


def coerce(df: DataFrame, schema: list[dict[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Numeric features as numbers (unreadable ones NULL); other columns as they are."""

    def typed(entry: dict[str, str]) -> Column:
        value = quoted(entry["name"])
        if entry["dtype"].startswith(NUMERIC_TYPES):
            value = numeric_or_null(value)
        return value.alias(entry["name"])

    features = {c["name"] for c in schema}
    kept = [quoted(c) for c in keep or [] if c not in features]
    return df.select(*kept, *[typed(c) for c in schema])


def records_from_json(df: DataFrame, column: str, schema: list[dict[str, str]]) -> DataFrame:
    """JSON records as feature columns, plus ``missing``: the features a record lacks."""
    record = F.from_json(quoted(column), "map<string,string>")
    parsed = df.withColumn("_record", record)
    names = [c["name"] for c in schema]
    present = F.coalesce(F.map_keys("_record"), F.array().cast("array<string>"))
    return parsed.select(
        *[quoted(c) for c in df.columns],
        *[F.try_element_at("_record", F.lit(n)).alias(n) for n in names],
        F.array_except(F.array(*[F.lit(n) for n in names]), present).alias("missing"),
    )


def predict(run: FittedRun, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(keep…, prediction, probabilities)`` for classes, ``(keep…, prediction)`` for numbers.

    Works on batch and, for models other than nearest neighbours with large training sets, on
    streaming frames alike.
    """
    check_schema(df, run.feature_schema)
    scored = run.score(coerce(df, run.feature_schema, keep))
    kept = [quoted(c) for c in keep or []]
    if run.task != CLASSIFICATION:
        return scored.select(*kept, F.col("prediction").cast("double").alias("prediction"))
    names = F.array(*[F.lit(n) for n in run.class_names])
    label = decode_label(F.col("prediction"), run.class_names)
    if "scores" not in scored.columns:
        return scored.select(*kept, label.alias("prediction"))
    return scored.select(
        *kept,
        label.alias("prediction"),
        F.map_from_arrays(names, "scores").alias("probabilities"),
    )


def predict_json(run: FittedRun, df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Score JSON records. A record without a required feature is an error."""
    parsed = records_from_json(df, column, run.feature_schema)
    bad = parsed.filter(F.size("missing") > 0).select("missing").limit(1).collect()
    if bad:
        raise ScoringError(f"A record misses required features: {list(bad[0]['missing'])}.")
    return predict(run, parsed, keep)
