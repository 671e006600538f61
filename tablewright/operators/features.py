"""Declarative feature engineering, fitted into a Spark ML ``PipelineModel``.

Fitting computes parameters (fill values, scales, category lists) in a few aggregates. The
fitted pipeline holds only JVM stages: imputing and scaling are column expressions in a
``SQLTransformer``, so they run inside whole-stage code generation, save with the model and
apply unchanged to batch and streaming frames.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.errors import FeatureConfigError
from tablewright.functions.scalars import normalise_missing, quoted
from tablewright.ml.principal import principal_directions, projection
from tablewright.operators.profile import type_family, unpivot_by_type
from tablewright.operators.quantiles import exact_quantiles

# The accepted settings.
NUMERIC_IMPUTERS = ("mean", "median", "most_frequent", "constant")
CATEGORICAL_IMPUTERS = ("most_frequent", "constant")
ENCODERS = ("onehot", "ordinal")
SCALERS = ("standard", "minmax", "robust", "none")
SELECTORS = ("none", "variance", "kbest")
CONTINUOUS_DISTINCT = 20
PREVIEW_ROWS = 10



@dataclass
class Imputation:
    """How missing values are filled."""

    numeric_strategy: str = "median"
    categorical_strategy: str = "most_frequent"
    numeric_fill_value: float = 0.0
    categorical_fill_value: str = "missing"


@dataclass
class FeatureConfig:
    """What the feature pipeline does."""

    target: str | None = None
    imputation: Imputation = field(default_factory=Imputation)
    encoding: str = "onehot"
    scaling: str = "standard"
    selection_method: str = "none"
    selection_k: int = 10
    variance_threshold: float = 0.0
    pca_enabled: bool = False
    pca_components: float | int | None = None
    max_categories: int | None = None  # refuse a column with more values; None: any number

    @classmethod
    def from_dict(cls, values: dict) -> FeatureConfig:
        """From plain (JSON) values; unknown names are errors."""
        values = dict(values)
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise FeatureConfigError(f"Unknown feature settings: {sorted(unknown)}")
        imputation = values.pop("imputation", {})
        if isinstance(imputation, dict):
            imputation = Imputation(**imputation)
        return cls(imputation=imputation, **values)

    def to_json(self) -> str:
        """As JSON text, the form stored with an experiment."""
        return json.dumps(asdict(self))

    def validate(self) -> None:
        """Raise :class:`FeatureConfigError` for a setting outside its domain."""
        choices = (
            ("numeric imputer", self.imputation.numeric_strategy, NUMERIC_IMPUTERS),
            ("categorical imputer", self.imputation.categorical_strategy, CATEGORICAL_IMPUTERS),
            ("scaling", self.scaling, SCALERS),
            ("encoding", self.encoding, ENCODERS),
            ("selection method", self.selection_method, SELECTORS),
        )
        for what, value, allowed in choices:
            if value not in allowed:
                raise FeatureConfigError(f"Invalid {what} {value!r}; choose from {allowed}.")
        if not 1 <= self.selection_k <= 1000:
            raise FeatureConfigError("selection_k must lie between 1 and 1000.")
        if self.variance_threshold < 0:
            raise FeatureConfigError("variance_threshold must not be negative.")
        if self.pca_components is not None and self.pca_components < 0:
            raise FeatureConfigError("pca_components must not be negative.")


@dataclass
class FittedFeatures:
    """A fitted feature pipeline and the names of what goes in and out."""

    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    names: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the vector column ``features``."""
        return self.model.transform(df)

    def transform_long(self, df: DataFrame, key: list[str]) -> DataFrame:
        """``(key…, feature, value)`` rows instead of a vector."""
        named = F.array(*[F.lit(n) for n in self.names])
        cells = F.arrays_zip(named.alias("feature"), vector_to_array("features").alias("value"))
        return (
            self.transform(df)
            .select(*[quoted(k) for k in key], F.explode(cells).alias("_cell"))
            .select(
                *[quoted(k) for k in key],
                F.col("_cell.feature").alias("feature"),
                F.col("_cell.value").alias("value"),
            )
        )


def split_feature_columns(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical (text, boolean) inputs; dates and the target are left out."""
    families = {f.name: type_family(f.dataType) for f in df.schema.fields if f.name != target}
    numeric = [n for n, kind in families.items() if kind == "numeric"]
    categorical = [n for n, kind in families.items() if kind in ("text", "boolean")]
    return numeric, categorical


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value per column, the smallest one on ties; no entry without values."""
    found: dict[str, object] = {}
    for _, long in unpivot_by_type(df, columns):
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        best = counts.groupBy("column").agg(
            F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b")
        )
        found.update({r["column"]: r["b"]["value"] for r in best.collect()})
    return found


def _as_text(df: DataFrame, name: str):
    """A categorical column as text; booleans read True and False."""
    text = quoted(name).cast("string")
    boolean = isinstance(df.schema[name].dataType, T.BooleanType)
    return F.initcap(text) if boolean else text


def numeric_fills(df: DataFrame, columns: list[str], config: FeatureConfig) -> dict[str, float]:
    """Fill value per numeric column; columns without any value get none (they are dropped)."""
    strategy = config.imputation.numeric_strategy
    if not columns:
        return {}
    if strategy == "constant":
        return {c: float(config.imputation.numeric_fill_value) for c in columns}
    if strategy == "most_frequent":
        found = most_frequent(df, columns)
    elif strategy == "mean":
        row = df.agg(*[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)])
        row = row.first()
        found = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    else:
        found = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    return {c: float(found[c]) for c in columns if found.get(c) is not None}


def scale_parameters(filled: DataFrame, columns: list[str], scaling: str) -> dict[str, tuple[float, float]]:
    """``(shift, divisor)`` per filled column; a divisor of zero becomes one."""
    if scaling == "none" or not columns:
        return {c: (0.0, 1.0) for c in columns}
    if scaling == "robust":
        quartiles = exact_quantiles(filled, columns, [0.25, 0.5, 0.75])
        pairs = {c: (q[1], q[2] - q[0]) for c, q in quartiles.items()}
    else:
        low, high = (
            (F.avg, F.stddev_pop) if scaling == "standard" else (F.min, F.max)
        )
        row = filled.agg(
            *[low(quoted(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
            *[high(quoted(c).cast("double")).alias(f"b{i}") for i, c in enumerate(columns)],
        ).first()
        pairs = {}
        for i, c in enumerate(columns):
            a, b = row[f"a{i}"], row[f"b{i}"]
            pairs[c] = (a, b) if scaling == "standard" else (a, b - a)
    return {c: (float(a), float(b) if b else 1.0) for c, (a, b) in pairs.items()}


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_double(value: float) -> str:
    return f"({float(value)!r}D)"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Chain:
    """Stages fitted one after the other, and the frame they lead to."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        self.stages: list = []

    def add(self, stage):
        """Fit ``stage`` if it is an estimator, apply it, and return the fitted stage."""
        if isinstance(stage, Estimator):
            stage = stage.fit(self.frame)
        self.stages.append(stage)
        self.frame = stage.transform(self.frame)
        return stage


def fit_features(
    df: DataFrame, config: FeatureConfig, label: str | None = None, task: str | None = None
) -> FittedFeatures:
    """Fit the pipeline on ``df``; ``label`` (a numeric column) is needed by ``kbest`` only.

    ``task`` says what ``label`` is, ``classification`` or ``regression``; without it a floating
    column with more than 20 values counts as a number.
    """
    config.validate()
    hidden = [c for c in (config.target, label) if c]
    inputs = df.drop(*[c for c in hidden if c in df.columns])
    numeric, categorical = split_feature_columns(inputs)
    if not numeric and not categorical:
        raise FeatureConfigError("No feature columns are left after excluding the target.")
    df = normalise_missing(df)

    fills = numeric_fills(df, numeric, config)
    used_numeric = [c for c in numeric if c in fills]
    filled = df.select(
        *[F.coalesce(quoted(c).cast("double"), F.lit(fills[c])).alias(c) for c in used_numeric]
    )
    scales = scale_parameters(filled, used_numeric, config.scaling)

    text_fills = _categorical_fills(df, categorical, config)
    used_categorical = [c for c in categorical if c in text_fills]
    if not used_numeric and not used_categorical:
        raise FeatureConfigError("All feature columns are empty.")

    expressions = []
    for i, c in enumerate(used_numeric):
        shift, divisor = scales[c]
        value = f"coalesce(nanvl(try_cast({_sql_name(c)} as double), null), {_sql_double(fills[c])})"
        if config.scaling != "none":
            value = f"({value} - {_sql_double(shift)}) / {_sql_double(divisor)}"
        expressions.append(f"{value} as _num{i}")
    for i, c in enumerate(used_categorical):
        text = f"cast({_sql_name(c)} as string)"
        if isinstance(df.schema[c].dataType, T.BooleanType):
            text = f"initcap({text})"
        expressions.append(f"coalesce({text}, {_sql_text(text_fills[c])}) as _cat{i}")
    chain = _Chain(df)
    chain.add(SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__"))

    numbers = [f"_num{i}" for i in range(len(used_numeric))]
    texts = [f"_cat{i}" for i in range(len(used_categorical))]
    positions = [f"_idx{i}" for i in range(len(used_categorical))]
    temporary = [*numbers, *texts, *positions]
    names = [f"numeric__{c}" for c in used_numeric]
    columns = list(numbers)
    if texts:
        indexer = chain.add(
            StringIndexer(
                inputCols=texts, outputCols=positions, stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
        if config.encoding == "onehot":
            encoded = [f"_hot{i}" for i in range(len(texts))]
            chain.add(OneHotEncoder(inputCols=positions, outputCols=encoded, dropLast=True))
            for c, labels in zip(used_categorical, indexer.labelsArray, strict=True):
                names += [f"categorical__{c}_{value}" for value in labels]
        else:
            encoded = [f"_ord{i}" for i in range(len(texts))]
            parts = [
                f"if({p} = {len(labels)}, -1.0D, {p}) as {e}"
                for p, e, labels in zip(positions, encoded, indexer.labelsArray, strict=True)
            ]
            chain.add(SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"))
            names += [f"categorical__{c}" for c in used_categorical]
        columns += encoded
        temporary += encoded

    selecting = config.selection_method != "none"
    raw = "features" if not selecting and not config.pca_enabled else "_assembled"
    chain.add(VectorAssembler(inputCols=columns, outputCol=raw))
    vectors = [raw]
    if selecting:
        kept = _selected(chain.frame, raw, config, label, df, task)
        out = "features" if not config.pca_enabled else "_selected"
        chain.add(VectorSlicer(inputCol=raw, outputCol=out, indices=kept))
        names = [names[i] for i in kept]
        vectors.append(out)
    if config.pca_enabled:
        k = _add_pca(chain, vectors[-1], len(names), config.pca_components)
        names = [f"pca{i}" for i in range(k)]
        vectors += ["_projected"]
    temporary += [v for v in vectors if v != "features"]
    chain.add(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(temporary)}) FROM __THIS__"))
    return FittedFeatures(PipelineModel(chain.stages), numeric, categorical, names)


def _categorical_fills(df, columns, config) -> dict[str, str]:
    """Fill value per categorical column, after a check of ``max_categories`` if it is set."""
    if not columns:
        return {}
    if config.max_categories is not None:
        counts = [F.count_distinct(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)]
        sizes = df.agg(*counts).first()
        for i, c in enumerate(columns):
            if sizes[f"n{i}"] > config.max_categories:
                raise FeatureConfigError(
                    f"Column {c!r} has {sizes[f'n{i}']} values, more than {config.max_categories}."
                )
    if config.imputation.categorical_strategy == "constant":
        return {c: config.imputation.categorical_fill_value for c in columns}
    texts = df.select(*[_as_text(df, c).alias(c) for c in columns])
    return {c: str(v) for c, v in most_frequent(texts, columns).items()}


def _selected(current, column, config, label, df, task) -> list[int]:
    if config.selection_method == "variance":
        summary = current.select(
            Summarizer.metrics("variance", "count").summary(F.col(column)).alias("s")
        ).first()["s"]
        n = summary["count"]
        variance = summary["variance"].toArray() * (n - 1) / max(n, 1)
        kept = [i for i, v in enumerate(variance) if v > config.variance_threshold]
        if not kept:
            raise FeatureConfigError(
                f"No feature has a variance above {config.variance_threshold}."
            )
        return kept
    if label is None:
        raise FeatureConfigError("K-best selection needs a target.")
    number = is_continuous(df, config.target or label) if task is None else task == "regression"
    if number:
        scores = f_regression(current, column, label)
    else:
        scores = anova_f(current, column, label)
    order = sorted(range(len(scores)), key=lambda i: (-np.inf if np.isnan(scores[i]) else scores[i], i))
    return sorted(order[-config.selection_k:])


def is_continuous(df: DataFrame, target: str) -> bool:
    """A floating target with more than 20 distinct values."""
    if not isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        return False
    distinct = df.select(quoted(target)).filter(quoted(target).isNotNull()).distinct()
    return len(distinct.limit(CONTINUOUS_DISTINCT + 1).collect()) > CONTINUOUS_DISTINCT


def anova_f(df: DataFrame, column: str, label: str) -> np.ndarray:
    """One-way ANOVA F per vector element; NaN for a constant element.

    One grouped summary per class, then one row per (element, class): the classes never meet in
    one row, however many there are.
    """
    classes = (
        df.groupBy(quoted(label).alias("c"))
        .agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(column)).alias("s"))
        .select(
            F.col("s.count").cast("double").alias("n"),
            F.posexplode(
                F.arrays_zip(
                    vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v")
                )
            ).alias("i", "e"),
        )
        .select("n", "i", F.col("e.m").alias("m"), F.col("e.v").alias("v"))
    )
    same = Window.partitionBy("i")
    centred = classes.withColumn(
        "d", F.col("m") - F.sum(F.col("m") * F.col("n")).over(same) / F.sum("n").over(same)
    )
    between = F.sum(F.col("n") * F.col("d") * F.col("d")) / F.nullif(F.count("*") - 1, F.lit(0))
    within = F.sum((F.col("n") - 1) * F.col("v")) / F.nullif(
        F.sum("n") - F.count("*"), F.lit(0.0)
    )
    rows = (
        centred.groupBy("i")
        .agg(between.alias("b"), within.alias("w"))
        .select("i", F.when(F.col("w") > 0, F.col("b") / F.col("w"))
                .when(F.col("b") > 0, F.lit(float("inf"))).alias("f"))
        .orderBy("i")
        .collect()
    )
    return np.array([np.nan if r["f"] is None else r["f"] for r in rows])


def f_regression(df: DataFrame, column: str, label: str) -> np.ndarray:
    """F of the correlation of every vector element with the label; 0 for a constant element.

    The cross products come from a weighted summary with the shifted label as weight, so all
    elements are handled in one pass whatever the vector's width.
    """
    y = quoted(label).cast("double")
    low = df.agg(F.min(y).alias("m")).first()["m"]
    weighted = df.withColumn("_w", y - F.lit(low))
    row = weighted.agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col(column)).alias("s"),
        Summarizer.metrics("mean").summary(F.col(column), F.col("_w")).alias("t"),
        F.avg("_w").alias("mw"),
        F.var_samp("_w").alias("vw"),
    ).first()
    n = row["s"]["count"]
    covariance = row["mw"] * (row["t"]["mean"].toArray() - row["s"]["mean"].toArray()) * n / (n - 1)
    spread = row["s"]["variance"].toArray() * row["vw"]
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(spread > 0, covariance**2 / spread, 0.0)
        return np.where(r2 < 1, r2 / (1 - r2) * (n - 2), np.finfo(float).max)


def _add_pca(chain: _Chain, column: str, width: int, components: float | int | None) -> int:
    """Project on the principal directions and centre; returns their number. The vectors are centred
    after the projection, so sparse ones stay sparse."""
    share = components if components is not None and 0 < components < 1 else None
    count = None if components is None or share is not None else int(components)
    if count is not None:
        full = min(chain.frame.limit(width).count(), width)
        if not 1 <= count <= full:
            raise FeatureConfigError(f"pca_components must lie between 1 and {full}.")
    directions, _ = principal_directions(chain.frame, column, count, share)
    chain.add(projection(directions, column, "_projected"))
    chain.add(StandardScaler(inputCol="_projected", outputCol="features", withMean=True, withStd=False))
    return directions.shape[1]


@dataclass
class FeaturePreview:
    """What a feature pipeline makes of a table."""

    n_features_in: int
    n_features_out: int
    numeric_columns: list[str]
    categorical_columns: list[str]
    output_features: list[str]
    sample: DataFrame


def preview_features(
    df: DataFrame, config: FeatureConfig, order_by: list[str] | None = None
) -> FeaturePreview:
    """Fit on ``df`` and show ten transformed rows, rounded to six decimals."""
    label = None
    if config.selection_method == "kbest" and config.target in df.columns:
        label = "_label"
        if type_family(df.schema[config.target].dataType) == "numeric":
            df = df.withColumn(label, quoted(config.target).cast("double"))
        else:
            df = df.withColumn(label, F.xxhash64(quoted(config.target)).cast("double"))
    fitted = fit_features(df, config, label)
    rows = fitted.transform(df)
    if order_by:
        rows = rows.orderBy(*[quoted(c) for c in order_by])
    sample = rows.limit(PREVIEW_ROWS).select(
        *[quoted(c) for c in order_by or []],
        F.transform(vector_to_array("features"), lambda v: F.round(v, 6)).alias("features"),
    )
    return FeaturePreview(
        len(fitted.numeric) + len(fitted.categorical),
        len(fitted.names),
        fitted.numeric,
        fitted.categorical,
        fitted.names,
        sample,
    )
