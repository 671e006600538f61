"""Explanations of a fitted run, computed by batched scoring on the cluster.

"Another row's value" (for shuffled columns and for Shapley backgrounds) is the next row's value
in a seeded random order inside random buckets of about a thousand rows. That is one bounded
window, with no join and nothing broadcast, and each bucket's values are exactly permuted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.scalars import order_hash, quoted
from tablewright.ml.algorithms import CLASSIFICATION
from tablewright.operators import metrics as M
from tablewright.operators.quantiles import exact_quantiles
from tablewright.plans.automl import FittedRun, scored_frame

# Fixed values of the reference behaviour.
REPEATS = 5
SHOWN_FEATURES = 20

BUCKET_ROWS = 1000
WALKED_VALUES = 4_000_000  # numbers of the vectors made at once


def explain_sample(
    df: DataFrame, key: list[str], rows: int | None = None, seed: int = 42
) -> DataFrame:
    """The first ``rows`` rows in a seeded hash order; all rows if ``rows`` is None."""
    if rows is None:
        return df
    hashed = df.withColumn("_hash", order_hash(key, seed))
    return hashed.orderBy("_hash", *[quoted(k) for k in key]).limit(rows).drop("_hash")


def with_donor(
    df: DataFrame, donor: Column, key: list[str], group: str, seed: int, out: str
) -> DataFrame:
    """Add another row's ``donor`` value, drawn anew for every value of ``group``."""
    buckets = df.count() // BUCKET_ROWS + 1
    hashed = df.withColumn("_h", order_hash([*key, group], seed)).withColumn(
        "_b", F.pmod("_h", F.lit(buckets))
    )
    order = Window.partitionBy(group, "_b").orderBy("_h", *[quoted(k) for k in key])
    first = F.first(donor).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hashed.withColumn(out, F.coalesce(F.lead(donor).over(order), first)).drop("_h", "_b")


def permutation_importance(
    run: FittedRun,
    df: DataFrame,
    *,
    key: list[str],
    metric: str | None = None,
    repeats: int = REPEATS,
    seed: int = 42,
) -> DataFrame:
    """``(feature, importance, std)``: loss of score when one input column is shuffled.

    ``df`` holds the features and the encoded ``label``. All copies (repeat x feature) are
    scored in one transform and measured in one grouped aggregate.
    """
    metric = metric or run.primary_metric
    classes = run.n_classes if run.task == CLASSIFICATION else 0
    names = [c["name"] for c in run.feature_schema]
    base = df.select(*[quoted(c) for c in dict.fromkeys([*key, *names, "label"])])
    before = M.metric_frame(run.score(base), metric, classes).first()["value"]
    repeated = base.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    donors = F.struct(*[quoted(c) for c in names])
    mixed = with_donor(repeated, donors, key, "_repeat", seed, "_donor").withColumn(
        "_feature", F.explode(F.array(*[F.lit(c) for c in names]))
    )
    shuffled = mixed.select(
        "_repeat",
        "_feature",
        "label",
        *[
            F.when(F.col("_feature") == c, F.col("_donor").getField(c))
            .otherwise(quoted(c))
            .alias(c)
            for c in names
        ],
    )
    after = M.metric_frame(run.score(shuffled), metric, classes, ["_feature", "_repeat"])
    drop = F.lit(before) - F.col("value")
    return (
        after.groupBy(F.col("_feature").alias("feature"))
        .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std"))
        .orderBy(F.desc("importance"), "feature")
    )


def _outputs(run: FittedRun, scored: DataFrame) -> Column:
    """What a model says, as an array: numbers, the second class, or all classes."""
    if run.task != CLASSIFICATION or "scores" not in scored.columns:
        return F.array(F.col("prediction").cast("double"))
    if run.n_classes == 2:
        return F.array(F.get("scores", F.lit(1)))
    return F.col("scores")


def _walk(keys: list[str], width: int):
    """For each row and draw the vectors on the way from the other row to the row: features switch in
    a random order, one at a time. ``gained`` is the feature that switched last, ``lost`` the next."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, WALKED_VALUES // (width + 1) ** 2)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                n = part.num_rows
                x, z = (part.column(c).flatten().to_numpy().reshape(n, width) for c in ("_x", "_z"))
                h = part.column("_h").to_numpy().view(np.uint64)
                with np.errstate(over="ignore"):
                    mixed = (h[:, None] ^ (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                order = np.argsort(mixed ^ (mixed >> np.uint64(29)), axis=1)
                rank = np.argsort(order, axis=1)  # the place of each feature in the order
                own = rank[:, None, :] < np.arange(width + 1)[None, :, None]
                vectors = np.where(own, x[:, None, :], z[:, None, :]).ravel()
                none = np.full((n, 1), -1)
                columns = [part.column(k).take(pa.array(np.repeat(np.arange(n), width + 1))) for k in keys]
                ends = pa.array(np.arange(n * (width + 1) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [
                        *columns, pa.array(np.hstack([none, order]).ravel().astype(np.int32)),
                        pa.array(np.hstack([order, none]).ravel().astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(vectors)),
                    ],
                    [*keys, "_gained", "_lost", "_v"],
                )

    return walk


def shapley_importance(
    run: FittedRun, df: DataFrame, *, key: list[str], draws: int = 10, seed: int = 42
) -> DataFrame:
    """``(feature, importance)``: mean absolute Shapley value per transformed feature.

    Sampled as in Štrumbelj and Kononenko (2014): a random feature order and a random other row
    per draw; features switch from the other row's values to the row's own, one at a time. A draw
    costs one vector more than there are features; each output counts for the feature that
    switched before it and against the one that switches after it, so the sums need no order.
    """
    vectors = run.features.transform(df).select(
        *[quoted(k) for k in key], vector_to_array("features").alias("_x")
    )
    width = len(run.features.names)
    drawn = vectors.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pairs = with_donor(drawn, F.col("_x"), key, "_draw", seed, "_z").select(
        *[quoted(k) for k in key], "_x", "_z", F.xxhash64(*[quoted(k) for k in key], "_draw", F.lit(seed)).alias("_h")
    )
    schema = T.StructType([vectors.schema[k] for k in key])
    schema = schema.add("_gained", T.IntegerType()).add("_lost", T.IntegerType()).add("_v", T.ArrayType(T.DoubleType()))
    walked = pairs.mapInArrow(_walk(key, width), schema).withColumn("features", array_to_vector("_v")).drop("_v")
    scored = scored_frame(run.model, walked, run.task == CLASSIFICATION)
    values = scored.select(
        *[quoted(k) for k in key], "_gained", "_lost", F.posexplode(_outputs(run, scored)).alias("_class", "_value")
    )
    signed = values.select(
        *[quoted(k) for k in key], "_class",
        F.explode(F.array(
            F.struct(F.col("_gained").alias("i"), F.col("_value").alias("v")),
            F.struct(F.col("_lost").alias("i"), (-F.col("_value")).alias("v")),
        )).alias("_s"),
    ).filter("_s.i >= 0")
    per_row = signed.groupBy(*[quoted(k) for k in key], F.col("_s.i").alias("_i"), "_class").agg(
        (F.sum("_s.v") / draws).alias("_phi")
    )
    names = F.array(*[F.lit(n) for n in run.features.names])
    return (
        per_row.groupBy("_i")
        .agg(F.avg(F.abs("_phi")).alias("importance"))
        .select(F.get(names, F.col("_i")).alias("feature"), "importance")
        .orderBy(F.desc("importance"), "feature")
    )


def partial_dependence(
    run: FittedRun, df: DataFrame, feature: str, *, points: int = 10
) -> DataFrame:
    """``(value, class, mean_output)``: mean output when a numeric feature is set to a value.

    The values are quantiles of the feature; every row is scored at each of them.
    """
    shares = [i / (points - 1) for i in range(points)]
    grid = sorted(set(exact_quantiles(df, [feature], shares)[feature]))
    names = [c["name"] for c in run.feature_schema]
    spread = df.select(
        *[quoted(c) for c in names if c != feature],
        F.explode(F.array(*[F.lit(float(v)) for v in grid])).alias(feature),
    ).withColumn("_value", quoted(feature))
    scored = run.score(spread)
    return (
        scored.select("_value", F.posexplode(_outputs(run, scored)).alias("class", "_out"))
        .groupBy(F.col("_value").alias("value"), "class")
        .agg(F.avg("_out").alias("mean_output"))
    )


def explain(
    run: FittedRun, df: DataFrame, *, key: list[str], rows: int | None = None,
    metric: str | None = None, seed: int = 42,
) -> dict[str, DataFrame]:
    """Permutation importance and the 20 largest Shapley importances of a (sampled) table."""
    sample = explain_sample(df, key, rows, seed)
    return {
        "permutation_importance": permutation_importance(
            run, sample, key=key, metric=metric, seed=seed
        ),
        "shap": shapley_importance(run, sample, key=key, seed=seed).limit(SHOWN_FEATURES),
    }
