"""Evaluation of predictions as aggregates.

Classification frames carry ``label`` and ``prediction`` (class positions) and, for the ranking
metrics, ``score`` (binary) or ``scores`` (array, one probability per class). Everything is
computed from confusion counts or from counts grouped by score, never from sorted rows in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scalars import order_hash, quoted
from tablewright.operators.ordering import running_totals

# Metrics where lower is better, the metrics allowed to choose a run, defaults.
ERROR_METRICS = ("mae", "mse", "rmse", "mape")
PRIMARY_METRICS = {
    "classification": ("accuracy", "f1_weighted", "f1_macro", "roc_auc"),
    "regression": ("r2", "rmse", "mae"),
}
DEFAULT_METRIC = {"classification": "f1_weighted", "regression": "r2"}


def ranking_score(metric: Column | str, value: Column) -> Column:
    """Higher is better: error metrics are negated, an absent value stays NULL."""
    if isinstance(metric, str):
        return -value if metric in ERROR_METRICS else value
    return F.when(metric.isin(*ERROR_METRICS), -value).otherwise(value)


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """``(label, prediction, n)`` for the pairs that occur, per group ``by``."""
    return df.groupBy(
        *(by or []),
        quoted(label).cast("int").alias("label"),
        quoted(prediction).cast("int").alias("prediction"),
    ).agg(F.count("*").alias("n"))


def confusion_matrix(
    df: DataFrame, n_classes: int, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """All ``n_classes`` x ``n_classes`` cells, zeros included."""
    positions = F.sequence(F.lit(0), F.lit(n_classes - 1))
    grid = (
        df.sparkSession.range(n_classes)
        .select(F.col("id").cast("int").alias("label"))
        .withColumn("prediction", F.explode(positions))
    )
    counts = confusion_counts(df, label, prediction)
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def per_class(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Support, precision, recall and F1 of every class in truth or prediction."""
    by = by or []
    counts = confusion_counts(df, label, prediction, by)
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n"))
                    .otherwise(0)
                    .alias("hits"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    return sums.select(
        *by,
        "class",
        "support",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Accuracy, weighted precision / recall / F1, macro F1: one row (per group ``by``).

    The support-weighted recall is the accuracy, so one pass over the confusion counts is enough.
    """
    by = by or []
    weight = F.sum("support").cast("double")

    def weighted(name: str) -> Column:
        return F.try_divide(F.sum(F.col(name) * F.col("support")), weight)

    return per_class(df, label, prediction, by).groupBy(*by).agg(
        weighted("recall").alias("accuracy"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
    )


def score_counts(
    df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None
) -> DataFrame:
    """``(score, pos, neg)``: the rows packed by score."""
    return df.groupBy(*(by or []), quoted(score).cast("double").alias("score")).agg(
        F.count_if(quoted(label) == 1).alias("pos"), F.count_if(quoted(label) != 1).alias("neg")
    )


def _area(ranked: DataFrame, by: list[str], *extra: Column) -> DataFrame:
    """ROC areas from running counts of negatives; ties count half."""
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"), *extra)


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None
) -> DataFrame:
    """One row ``roc_auc`` (per group ``by``): exact; NULL with a single class. A NULL score ranks
    below all others, NaN above."""
    by = by or []
    packed = score_counts(df, label, score, by)
    return _area(running_totals(packed, order="score", sums=["neg"], by=by), by)


def roc_auc_multiclass(
    df: DataFrame, label: str = "label", scores: str = "scores", by: list[str] | None = None
) -> DataFrame:
    """One row ``roc_auc`` (per group ``by``): one class against the rest, by prevalence.

    All classes are ranked in one plan over rows packed by (class, score). NULL if a class is
    never, or always, the truth.
    """
    by = by or []
    packed = (
        df.select(
            *by,
            quoted(label).cast("int").alias("label"),
            F.posexplode(quoted(scores)).alias("class", "score"),
        )
        .groupBy(*by, "class", "score")
        .agg(
            F.count_if(F.col("label") == F.col("class")).alias("pos"),
            F.count_if(F.col("label") != F.col("class")).alias("neg"),
        )
    )
    ranked = running_totals(packed, order="score", sums=["neg"], by=[*by, "class"])
    areas = _area(ranked, [*by, "class"], F.sum("pos").alias("size"))
    mean = F.try_divide(F.sum(F.col("roc_auc") * F.col("size")), F.sum("size").cast("double"))
    return areas.groupBy(*by).agg(
        F.when(F.count_if(F.col("roc_auc").isNull()) == 0, mean).alias("roc_auc")
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score, and the origin (threshold NULL)."""
    packed = score_counts(df, label, score)
    ranked = running_totals(packed, order="score", sums=["pos", "neg"], ascending=False)
    totals = packed.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    positives, negatives = float(totals["p"] or 0), float(totals["n"] or 0)
    points = ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.lit(negatives)).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.lit(positives)).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return origin.unionByName(points)


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """r2, mae, mse, rmse, explained variance; mape is NULL if a true value is 0.

    A constant target gives r2 (and explained variance) 1 for perfect predictions, else 0.
    """
    y, guess = quoted(label).cast("double"), quoted(prediction).cast("double")
    error = y - guess
    mse = F.avg(error * error)

    def share(rest: Column) -> Column:
        total = F.var_pop(y)
        return (
            F.when(total > 0, 1 - F.try_divide(rest, total))
            .when(rest == 0, F.lit(1.0))
            .otherwise(F.lit(0.0))
        )

    size = F.when(y != 0, F.abs(F.try_divide(error, y)))
    return df.groupBy(*(by or [])).agg(
        share(mse).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        share(F.var_pop(error)).alias("explained_variance"),
        F.when(F.count_if(y == 0) == 0, F.avg(size)).alias("mape"),
    )


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Add ``residual``: truth minus prediction."""
    return df.withColumn("residual", quoted(label).cast("double") - quoted(prediction).cast("double"))


def predicted_vs_actual(
    df: DataFrame,
    *,
    key: list[str],
    label: str = "label",
    prediction: str = "prediction",
    points: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Points of the predicted-versus-actual chart; ``points`` draws a seeded sample of them."""
    if points is not None:
        df = df.withColumn("_hash", order_hash(key, seed)).orderBy("_hash", *key).limit(points)
    return df.select(
        *[quoted(k) for k in key],
        quoted(label).cast("double").alias("actual"),
        quoted(prediction).cast("double").alias("predicted"),
    )


def ideal_line(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Ends of the ideal line: smallest and largest of truth and prediction."""
    return df.agg(
        F.least(F.min(label), F.min(prediction)).cast("double").alias("low"),
        F.greatest(F.max(label), F.max(prediction)).cast("double").alias("high"),
    )


def leaderboard(runs: DataFrame, experiment: str = "experiment_id") -> DataFrame:
    """Runs, best first, runs without a score last; earlier runs win ties."""
    return runs.orderBy(
        experiment, F.col("primary_score").desc_nulls_last(), F.col("position").asc()
    )


def best_runs(runs: DataFrame, experiment: str = "experiment_id") -> DataFrame:
    """The best completed run of each experiment; the first in list order wins ties.

    ``max_by`` combines on the map side, so an experiment with very many runs is no hot task.
    """
    usable = runs.filter((F.col("status") == "completed") & F.col("primary_score").isNotNull())
    best = usable.groupBy(experiment).agg(
        F.max_by(
            F.struct(*[quoted(c) for c in runs.columns if c != experiment]),
            F.struct("primary_score", (-F.col("position")).alias("first")),
        ).alias("b")
    )
    return best.select(experiment, "b.*")


def metric_frame(
    scored: DataFrame, metric: str, n_classes: int = 0, by: list[str] | None = None
) -> DataFrame:
    """``(by…, value)``: one metric of a scored frame, oriented so that higher is better."""
    by = by or []
    if metric == "roc_auc" and n_classes == 2:
        binary = scored.withColumn("_score", F.get("scores", F.lit(1)))
        frame = roc_auc(binary, score="_score", by=by)
    elif metric == "roc_auc":
        frame = roc_auc_multiclass(scored, by=by)
    elif n_classes:
        frame = classification_metrics(scored, by=by)
    else:
        frame = regression_metrics(scored, by=by)
    return frame.select(*by, ranking_score(metric, F.col(metric)).alias("value"))


def all_metrics(scored: DataFrame, n_classes: int = 0) -> dict[str, float]:
    """Every metric of the task that has a value."""
    if not n_classes:
        found = regression_metrics(scored).first().asDict()
    else:
        found = classification_metrics(scored).first().asDict()
        if "scores" in scored.columns:
            area = metric_frame(scored, "roc_auc", n_classes).first()
            found["roc_auc"] = area["value"] if area else None
    return {k: float(v) for k, v in found.items() if v is not None}
