"""The data behind exploratory charts, aggregated on the cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scalars import finite_or_null, normalise_missing, order_hash, quoted
from tablewright.operators.profile import (
    _per_column,
    correlation_matrix,
    correlation_pairs,
    fences,
    missing_by_column,
    numeric_columns,
    split_by_kind,
    top_values,
)
from tablewright.operators.quantiles import exact_quantiles

# Fixed values of the charts.
CHARTED_FEATURES = 20
CATEGORIES = 15
SCATTER_POINTS = 2000
SCATTER_SEED = 42


def missing_bars(df: DataFrame) -> DataFrame:
    """Missing values per column, most first."""
    return missing_by_column(df).orderBy(F.desc("n_missing"), "column")


def histograms(df: DataFrame, columns: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width bins per numeric column: ``(column, bin, low, high, count)``.

    Bins without rows are listed too. A constant column has all rows in bin 0.
    """
    columns = numeric_columns(df) if columns is None else columns
    finite = df.select(*[finite_or_null(quoted(c)).alias(c) for c in columns])
    ends = finite.agg(
        *[F.min(quoted(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(quoted(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    ranges = [
        (c, float(ends[f"lo{i}"]), float(ends[f"hi{i}"]))
        for i, c in enumerate(columns)
        if ends[f"lo{i}"] is not None
    ]
    schema = "column string, lo double, hi double"
    grid = (
        df.sparkSession.createDataFrame(ranges, schema)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select(
            "column",
            "bin",
            (F.col("lo") + (F.col("hi") - F.col("lo")) / bins * F.col("bin")).alias("low"),
            (F.col("lo") + (F.col("hi") - F.col("lo")) / bins * (F.col("bin") + 1)).alias("high"),
        )
    )
    if not ranges:
        return grid.withColumn("count", F.lit(0).cast("bigint"))
    binned = finite.select(
        *[
            F.when(
                quoted(c).isNotNull(),  # least() would skip a NULL
                F.least(
                    F.floor((quoted(c) - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1)
                ),
            ).alias(c)
            if hi > lo
            else F.when(quoted(c).isNotNull(), F.lit(0)).alias(c)
            for c, lo, hi in ranges
        ]
    )
    counts = (
        binned.unpivot([], [quoted(c) for c, _, _ in ranges], "column", "bin")
        .filter("bin is not null")
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    return grid.join(F.broadcast(counts), ["column", "bin"], "left").select(  # columns x bins
        "column", "bin", "low", "high",
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def box_plots(
    df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """Five numbers, whiskers (furthest values within the fences) and outlier count."""
    columns = numeric_columns(df) if columns is None else columns
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], accuracy=accuracy)
    rows = []
    for name in columns:
        value = quoted(name).cast("double")
        q = quartiles[name]
        fence = fences(q)
        if fence is None:
            continue
        inside = value.between(*fence)
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.min(value).alias("min"),
                F.min(F.when(inside, value)).alias("whisker_low"),
                F.lit(q[0]).alias("p25"),
                F.lit(q[1]).alias("median"),
                F.lit(q[2]).alias("p75"),
                F.max(F.when(inside, value)).alias("whisker_high"),
                F.max(value).alias("max"),
                F.count_if(~inside).alias("n_outliers"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame(
            [],
            "column string, min double, whisker_low double, p25 double, median double, "
            "p75 double, whisker_high double, max double, n_outliers bigint",
        )
    return _per_column(df, rows)


def category_bars(
    df: DataFrame, columns: list[str] | None = None, k: int = CATEGORIES
) -> DataFrame:
    """The ``k`` most frequent categories per column."""
    return top_values(df, columns, k).select("column", "rank", "value", "count")


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation matrix in long form; no rows below two numeric columns."""
    return correlation_matrix(df, columns)


def strongest_pair(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The pair with the largest absolute correlation; the first in column order wins ties."""
    return (
        correlation_pairs(df, columns)
        .filter("correlation is not null")
        .orderBy(F.abs("correlation").desc(), "i", "j")
        .limit(1)
        .select("a", "b", "correlation")
    )


def scatter_sample(
    df: DataFrame,
    x: str,
    y: str,
    *,
    key: list[str] | None = None,
    points: int = SCATTER_POINTS,
    seed: int = SCATTER_SEED,
) -> DataFrame:
    """At most ``points`` rows where both are present: the first in a seeded hash order.

    ``orderBy`` + ``limit`` keeps only ``points`` rows per task (TakeOrderedAndProject).
    """
    key = key or df.columns
    both = df.filter(quoted(x).isNotNull() & quoted(y).isNotNull())
    return (
        both.withColumn("_hash", order_hash(key, seed))
        .orderBy("_hash", *[quoted(c) for c in key])
        .limit(points)
        .select(*[quoted(c) for c in dict.fromkeys([*key, x, y])])
    )


@dataclass(frozen=True)
class ChartData:
    """The tidy frames behind the chart bundle."""

    missing: DataFrame
    correlations: DataFrame
    histograms: DataFrame
    box_plots: DataFrame
    categories: DataFrame
    scatter: DataFrame | None


def chart_data(
    df: DataFrame, *, bins: int = 20, key: list[str] | None = None, accuracy: int | None = None,
    charted: int | None = CHARTED_FEATURES,
) -> ChartData:
    """Chart data for the first ``charted`` numeric and categorical columns (None: all of them)."""
    df = normalise_missing(df)
    kinds = split_by_kind(df)
    numeric, categorical = kinds.numeric[:charted], kinds.categorical[:charted]
    pair = strongest_pair(df, kinds.numeric).first() if len(kinds.numeric) >= 2 else None
    return ChartData(
        missing=missing_bars(df),
        correlations=correlation_heatmap(df, kinds.numeric),
        histograms=histograms(df, numeric, bins),
        box_plots=box_plots(df, numeric, accuracy),
        categories=(
            category_bars(df, categorical)
            if categorical
            else df.sparkSession.createDataFrame(
                [], "column string, rank int, value string, count bigint"
            )
        ),
        scatter=scatter_sample(df, pair["a"], pair["b"], key=key) if pair else None,
    )
