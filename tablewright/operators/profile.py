"""Statistical profile of a table: schema, missing values, numbers, frequent values, correlation.

Every function takes a DataFrame whose NaNs are already NULL (``normalise_missing``) and returns
a tidy DataFrame. All numeric columns share one aggregate; frequent values and distinct counts
share one unpivot per type family, so each column is read once per question, not per statistic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.errors import DataLoadError
from tablewright.functions.scalars import (
    finite_columns,
    finite_or_null,
    normalise_missing,
    pct,
    quoted,
)
from tablewright.operators.quantiles import exact_quantiles

# Fixed values of the profile.
CATEGORICAL_UNIQUE_RATIO = 0.5
TOP_VALUES = 10
TOP_PAIRS = 15
WHISKER = 1.5

PAIRS_PER_SCAN = 300
COLUMNS_PER_SCAN = 100
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXTUAL = (T.StringType, T.CharType, T.VarcharType)
WIDTHS = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
          T.DateType: 4}


def type_family(data_type: T.DataType) -> str:
    """boolean, numeric, datetime or text; other types have no place in a tabular profile."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.NumericType,)):
        return "numeric"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, TEXTUAL):
        return "text"
    raise DataLoadError(f"Columns of type {data_type.simpleString()} are not supported.")


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in table order."""
    return [f.name for f in df.schema.fields if type_family(f.dataType) == "numeric"]


def _storage(field: T.StructField) -> str:
    """The typed stack in which a column's values are counted."""
    if isinstance(field.dataType, INTEGRAL):
        return "bigint"
    if isinstance(field.dataType, FLOATING):
        return "double"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz"
    if isinstance(field.dataType, T.DateType):
        return "date"
    return "string"


def unpivot_by_type(df: DataFrame, columns: list[str]) -> list[tuple[str, DataFrame]]:
    """``(column, value)`` rows, one frame per value type, so no value loses precision."""
    stacks: dict[str, list[T.StructField]] = {}
    for name in columns:
        field = df.schema[name]
        type_family(field.dataType)
        stacks.setdefault(_storage(field), []).append(field)
    frames = []
    for storage, fields in stacks.items():
        cast = df.select(*[quoted(f.name).cast(storage).alias(f.name) for f in fields])
        long = cast.unpivot([], [quoted(f.name) for f in fields], "column", "value")
        frames.append((storage, long.filter("value is not null")))
    return frames


def distinct_counts(df: DataFrame, columns: list[str], rsd: float | None = None) -> DataFrame:
    """``(column, n_unique)`` without nulls; exact, or HyperLogLog++ when ``rsd`` is given."""
    result = None
    for _, long in unpivot_by_type(df, columns):
        if rsd is None:
            part = long.distinct().groupBy("column").agg(F.count("*").alias("n_unique"))
        else:
            part = long.groupBy("column").agg(
                F.approx_count_distinct("value", rsd).alias("n_unique")
            )
        result = part if result is None else result.unionByName(part)
    return result


def _per_column(df: DataFrame, rows: list[Column]) -> DataFrame:
    """One aggregate over the table, turned into one row per struct."""
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def column_schema(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """One row per column: dtype, semantic type, missing values, distinct values."""
    if not df.columns:
        raise DataLoadError("The table has no columns.")
    base = _per_column(
        df,
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(type_family(f.dataType)).alias("family"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(quoted(f.name).isNull()).alias("n_missing"),
            )
            for i, f in enumerate(df.schema.fields)
        ],
    )
    uniques = distinct_counts(df, df.columns, rsd)
    n_unique = F.coalesce(F.col("n_unique"), F.lit(0).cast("bigint"))
    present = F.col("n_rows") - F.col("n_missing")
    few = (present == 0) | (n_unique.cast("double") <= CATEGORICAL_UNIQUE_RATIO * present)
    return base.join(F.broadcast(uniques), "column", "left").select(  # one row per column
        "position",
        "column",
        "dtype",
        F.when(F.col("family") != "text", F.col("family"))
        .when(few, F.lit("categorical"))
        .otherwise(F.lit("text"))
        .alias("inferred_type"),
        "n_missing",
        pct(F.col("n_missing"), F.col("n_rows")).alias("missing_pct"),
        n_unique.alias("n_unique"),
    )


@dataclass(frozen=True)
class ColumnKinds:
    """Columns by semantic type, in table order."""

    numeric: list[str]
    categorical: list[str]  # categorical and boolean
    text: list[str]
    datetime: list[str]


def split_by_kind(df: DataFrame, rsd: float | None = None) -> ColumnKinds:
    """Semantic type of every column. Only text columns need a pass over the data."""
    families = {f.name: type_family(f.dataType) for f in df.schema.fields}
    texts = [name for name, family in families.items() if family == "text"]
    few: set[str] = set()
    if texts:
        sized = column_schema(df.select(*[quoted(c) for c in texts]), rsd)
        few = {r["column"] for r in sized.filter("inferred_type = 'categorical'").collect()}
    return ColumnKinds(
        numeric=[n for n, f in families.items() if f == "numeric"],
        categorical=[n for n, f in families.items() if f == "boolean" or n in few],
        text=[n for n in texts if n not in few],
        datetime=[n for n, f in families.items() if f == "datetime"],
    )


def fences(quartiles: list[float | None]) -> tuple[float, float] | None:
    """Lower and upper outlier fence from the quartiles."""
    low, high = quartiles[0], quartiles[-1]
    if low is None or high is None:
        return None
    reach = WHISKER * (high - low)
    return low - reach, high + reach


@dataclass(frozen=True)
class Moments:
    """First-pass statistics of a numeric column."""

    count: int
    mean: float | None
    std: float | None  # sample deviation
    low: float | None
    high: float | None

    @property
    def constant(self) -> bool:
        return self.count == 0 or self.low == self.high


def column_moments(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, Moments]]:
    """Row count and :class:`Moments` per column, in one small-state aggregate.

    Later passes centre the values by these numbers and need plain sums only. Those compile to
    compact code, where many higher central moments in one aggregate outgrow the compiler.
    """
    functions = (F.count, F.avg, F.stddev_samp, F.min, F.max)
    n_rows, found = 0, {}
    for start in range(0, max(1, len(columns)), COLUMNS_PER_SCAN):
        batch = columns[start : start + COLUMNS_PER_SCAN]
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[
                f(quoted(c).cast("double")).alias(f"f{i}_{j}")
                for i, c in enumerate(batch)
                for j, f in enumerate(functions)
            ],
        ).first()
        n_rows = row["n"]
        for i, c in enumerate(batch):
            found[c] = Moments(*[row[f"f{i}_{j}"] for j in range(len(functions))])
    return n_rows, found


def numeric_summary(
    df: DataFrame,
    columns: list[str] | None = None,
    accuracy: int | None = None,
    first_pass: tuple[int, dict[str, Moments]] | None = None,
) -> DataFrame:
    """Thirteen statistics per numeric column; a column without values only has ``count`` 0.

    Three scans: first moments, quantiles, then everything that needs mean or fences.
    ``first_pass`` takes the result of :func:`column_moments` where it is known already.
    """
    columns = numeric_columns(df) if columns is None else columns
    n_rows, moments = first_pass or column_moments(df, columns)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], accuracy=accuracy)
    rows = []
    for i, name in enumerate(columns):
        value, m, q = quoted(name).cast("double"), moments[name], quartiles[name]
        fence = fences(q)
        outside = (value < fence[0]) | (value > fence[1]) if fence else F.lit(False)
        n = F.count(value)
        some = F.when(n > 0, F.lit(1))
        skew = kurt = F.when(n > 0, F.lit(0.0))
        if m.count > 2 and not m.constant:
            z = (value - F.lit(m.mean)) / F.lit(m.std)
            # z has sample variance 1, so its central moments need no second division
            size = float(m.count)
            second = (size - 1) / size
            third, fourth = F.avg(z * z * z), F.avg(z * z * z * z)
            skew = third / second**1.5 * (size * (size - 1)) ** 0.5 / (size - 2)
            if m.count > 3:
                excess = fourth / second**2 - 3
                kurt = (size - 1) / ((size - 2) * (size - 3)) * ((size + 1) * excess + 6)
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                n.alias("count"),
                F.lit(m.mean).cast("double").alias("mean"),
                F.lit(m.std if m.count != 1 else 0.0).cast("double").alias("std"),
                F.lit(m.low).cast("double").alias("min"),
                F.lit(q[0]).cast("double").alias("p25"),
                F.lit(q[1]).cast("double").alias("median"),
                F.lit(q[2]).cast("double").alias("p75"),
                F.lit(m.high).cast("double").alias("max"),
                skew.alias("skew"),
                kurt.alias("kurtosis"),
                (some * F.count_if(value == 0)).alias("n_zeros"),
                (some * F.count_if(value < 0)).alias("n_negative"),
                (some * F.count_if(outside)).alias("n_outliers"),
            )
        )
    return finite_columns(_per_column(df, rows))


def flag_outliers(
    df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """Add ``<column>_outlier``: strictly outside the IQR fences (NULL stays NULL)."""
    columns = numeric_columns(df) if columns is None else columns
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], accuracy=accuracy)
    flags = []
    for name in columns:
        fence = fences(quartiles[name])
        value = quoted(name).cast("double")
        flags.append(
            ((value < fence[0]) | (value > fence[1])).alias(f"{name}_outlier")
            if fence
            else F.lit(None).cast("boolean").alias(f"{name}_outlier")
        )
    return df.select("*", *flags)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, count)`` of every non-null value, the value as text."""
    result = None
    for _, long in unpivot_by_type(df, columns):
        part = long.groupBy("column", "value").agg(F.count("*").alias("count"))
        part = part.select("column", F.col("value").cast("string").alias("value"), "count")
        result = part if result is None else result.unionByName(part)
    booleans = [c for c in columns if isinstance(df.schema[c].dataType, T.BooleanType)]
    if booleans:
        result = result.withColumn(
            "value",
            F.when(F.col("column").isin(booleans), F.initcap("value")).otherwise(F.col("value")),
        )
    return result


def top_values(
    df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES
) -> DataFrame:
    """The ``k`` most frequent values per column with their share of the non-null rows.

    Ties are ordered by value. The ranking runs twice, first inside salted parts of each
    column, so that no task sorts all values of a column with many of them.
    """
    columns = split_by_kind(df).categorical if columns is None else columns
    counts = value_counts(df, columns)
    order = [F.desc("count"), F.asc("value")]
    totals = counts.groupBy("column").agg(
        F.sum("count").alias("_total"), F.count("*").alias("n_unique")
    )
    parts = counts.withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(256)))
    best = (
        parts.withColumn("_r", F.row_number().over(Window.partitionBy("column", "_part").orderBy(*order)))
        .filter(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
        .filter(F.col("rank") <= k)
    )
    return best.join(F.broadcast(totals), "column").select(  # one row per column
        "column", "n_unique", "rank", "value", "count",
        pct(F.col("count"), F.col("_total")).alias("pct"),
    )


def _pair_correlation(x: Column, y: Column, left: Moments, right: Moments, complete: bool) -> Column:
    """Pearson over the rows where both are present, from sums of standardised values.

    NULL (no error) if one side is constant over those rows.
    """
    if left.constant or right.constant:
        return F.lit(None).cast("double")
    dx = (x - F.lit(left.mean)) / F.lit(left.std)
    dy = (y - F.lit(right.mean)) / F.lit(right.std)
    if complete:  # centred over the very same rows: only the cross product is left
        return F.sum(dx * dy) / (left.count - 1)
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, F.lit(1))).cast("double")
    sx, sy = F.sum(F.when(both, dx)), F.sum(F.when(both, dy))
    sxx, syy = F.sum(F.when(both, dx * dx)), F.sum(F.when(both, dy * dy))
    spread = F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))
    varied = (F.min(F.when(both, x)) < F.max(F.when(both, x))) & (
        F.min(F.when(both, y)) < F.max(F.when(both, y))
    )
    return F.when(varied, F.try_divide(F.sum(F.when(both, dx * dy)) - sx * sy / n, spread))


def correlation_pairs(
    df: DataFrame,
    columns: list[str] | None = None,
    first_pass: tuple[int, dict[str, Moments]] | None = None,
) -> DataFrame:
    """``(i, j, a, b, correlation)`` for every pair of numeric columns, in column order."""
    columns = numeric_columns(df) if columns is None else columns
    spark = df.sparkSession
    schema = "i int, j int, a string, b string, correlation double"
    if len(columns) < 2:
        return spark.createDataFrame([], schema)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    n_rows, moments = first_pass or column_moments(df, columns)
    result = None
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        rows = []
        for i, j in pairs[start : start + PAIRS_PER_SCAN]:
            left, right = moments[columns[i]], moments[columns[j]]
            value = _pair_correlation(
                quoted(columns[i]).cast("double"),
                quoted(columns[j]).cast("double"),
                left,
                right,
                left.count == n_rows and right.count == n_rows,
            )
            rows.append(
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(j).alias("j"),
                    F.lit(columns[i]).alias("a"),
                    F.lit(columns[j]).alias("b"),
                    finite_or_null(value).alias("correlation"),
                )
            )
        part = _per_column(df, rows)
        result = part if result is None else result.unionByName(part)
    return result


def correlation_matrix(
    df: DataFrame,
    columns: list[str] | None = None,
    first_pass: tuple[int, dict[str, Moments]] | None = None,
) -> DataFrame:
    """The full matrix in long form, both halves and the diagonal; empty below two columns."""
    columns = numeric_columns(df) if columns is None else columns
    first_pass = first_pass or column_moments(df, columns)
    moments = first_pass[1]
    pairs = correlation_pairs(df, columns, first_pass)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct("a", "b", "correlation"),
                F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "correlation"),
            )
        ).alias("s")
    ).select("s.*")
    if len(columns) < 2:
        return sides
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, None if moments[c].constant else 1.0) for c in columns],
        "a string, b string, correlation double",
    )
    return sides.unionByName(diagonal)


def strongest_pairs(
    df: DataFrame,
    columns: list[str] | None = None,
    k: int = TOP_PAIRS,
    first_pass: tuple[int, dict[str, Moments]] | None = None,
) -> DataFrame:
    """The ``k`` pairs with the largest absolute correlation; ties in column order."""
    return (
        correlation_pairs(df, columns, first_pass)
        .filter("correlation is not null")
        .orderBy(F.abs("correlation").desc(), "i", "j")
        .limit(k)
        .select("a", "b", "correlation")
    )


def packed_rows(df: DataFrame, weight: str = "_n") -> DataFrame:
    """Distinct rows with their number of copies, nulls equal.

    Map-side combine packs first, so a row repeated billions of times is one row per task
    before the shuffle.
    """
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(weight))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``n_duplicate_rows``: copies beyond the first; exact.

    Digests of the rows are counted first; only rows whose digest occurs again are compared as
    they are. A digest leaves nulls out, which can only add rows to compare.
    """
    columns = [quoted(c) for c in df.columns]
    digested = df.withColumn("_d1", F.xxhash64(*columns)).withColumn("_d2", F.hash(*columns))
    seen = digested.groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = digested.join(seen.select("_d1", "_d2"), ["_d1", "_d2"], "left_semi")
    return packed_rows(again.drop("_d1", "_d2")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_rows")
    )


def logical_bytes(df: DataFrame, weight: Column) -> Column:
    """Estimated bytes of the values: fixed widths plus the length of text."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        value = quoted(field.name)
        if isinstance(field.dataType, TEXTUAL):
            size = F.sum(weight * F.octet_length(value))
        else:
            width = WIDTHS.get(type(field.dataType), 8)
            size = F.sum(F.when(value.isNotNull(), weight * width))
        total = total + F.coalesce(size, F.lit(0).cast("bigint"))
    return total


def missing_by_column(df: DataFrame) -> DataFrame:
    """``(column, n_missing)`` for the columns that miss values."""
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.count_if(quoted(c).isNull()).alias("n_missing")
        )
        for c in df.columns
    ]
    return _per_column(df, rows).filter("n_missing > 0")


def overview(
    df: DataFrame, rsd: float | None = None, kinds: ColumnKinds | None = None
) -> DataFrame:
    """One row: shape, duplicates, size, missing cells, number of columns by kind.

    One scan for the sums, and the digests of :func:`duplicate_rows`.
    """
    kinds = kinds or split_by_kind(df, rsd)
    weight = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    missing = none
    for c in df.columns:
        missing = missing + F.coalesce(F.sum(F.when(quoted(c).isNull(), weight)), none)
    width = len(df.columns)
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        logical_bytes(df, weight).alias("memory_bytes"),
        missing.alias("missing_cells"),
    )
    one = F.lit(1).alias("_one")  # both sides have one row
    totals = totals.select("*", one).join(duplicate_rows(df).select("*", one), "_one")
    return totals.select(
        "n_rows",
        F.lit(width).alias("n_columns"),
        "n_duplicate_rows",
        "memory_bytes",
        "missing_cells",
        pct(F.col("missing_cells"), F.col("n_rows") * width).alias("missing_cells_pct"),
        F.lit(len(kinds.numeric)).alias("n_numeric"),
        F.lit(len(kinds.categorical)).alias("n_categorical"),
    )


@dataclass(frozen=True)
class TableProfile:
    """The tidy parts of a full profile."""

    columns: DataFrame
    overview: DataFrame
    missing: DataFrame
    numeric: DataFrame
    top_values: DataFrame
    correlations: DataFrame
    top_pairs: DataFrame


def profile_table(
    df: DataFrame, accuracy: int | None = None, rsd: float | None = None
) -> TableProfile:
    """The full profile. ``accuracy`` and ``rsd`` trade exactness for less shuffling."""
    df = normalise_missing(df)
    kinds = split_by_kind(df, rsd)
    first_pass = column_moments(df, kinds.numeric)
    return TableProfile(
        columns=column_schema(df, rsd),
        overview=overview(df, rsd, kinds),
        missing=missing_by_column(df),
        numeric=numeric_summary(df, kinds.numeric, accuracy, first_pass),
        top_values=top_values(df, kinds.categorical),
        correlations=correlation_matrix(df, kinds.numeric, first_pass),
        top_pairs=strongest_pairs(df, kinds.numeric, first_pass=first_pass),
    )
