"""Target preparation, train/test split and folds.

Rows are ordered by a seeded hash of their key inside each class, so a split is exact in size,
stratified, independent of partitioning, and the same after any task retry.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.errors import TrainingError
from tablewright.functions.scalars import normalise_missing, numeric_or_null, order_hash, quoted
from tablewright.operators.categories import sorted_numbers
from tablewright.operators.ordering import CELL_BITS, HASH_BITS, hash_numbered, null_safe_join
from tablewright.session import cut_lineage


def class_names(df: DataFrame, target: str, keep_null: bool = False) -> list[str]:
    """Sorted class names of a target read as text; ``nan`` stands for NULL if kept."""
    text = quoted(target).cast("string")
    if keep_null:
        text = F.coalesce(text, F.lit("nan"))
    rows = df.select(text.alias("c")).filter("c is not null").distinct()
    names = sorted(r["c"] for r in rows.collect())
    if len(names) < 2:
        raise TrainingError("A classification target needs at least two classes.")
    return names


def encode_labels(
    df: DataFrame, target: str, names: list[str] | None = None, keep_null: bool = False,
    out: str = "label",
) -> DataFrame:
    """Add the position of the class among the sorted class names, as a double. Names that are not given
    are found and numbered over the cluster.

    Rows with a NULL target are dropped unless ``keep_null`` makes them the class ``nan``.
    """
    text = quoted(target).cast("string")
    if keep_null:
        text = F.coalesce(text, F.lit("nan"))
    known = df.filter(text.isNotNull()).withColumn("_class", text)
    if names is None:  # numbered where they are, however many there are
        classes = known.select(F.lit(0).alias("_group"), "_class")
        lookup = cut_lineage(sorted_numbers(classes, "_group", "_class").select("_class", F.col("position").cast("double").alias(out)))
        if lookup.limit(2).count() < 2:
            raise TrainingError("A classification target needs at least two classes.")
    else:
        lookup = df.sparkSession.createDataFrame(
            [(n, float(i)) for i, n in enumerate(names)], f"_class string, {out} double"
        )
    # Spark broadcasts the lookup by its size, or shuffles
    return known.join(lookup, "_class", "left").drop("_class")


def numeric_target(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Add the target as a double; rows where it is no number are dropped."""
    value = numeric_or_null(quoted(target))
    result = df.withColumn(out, value).filter(F.col(out).isNotNull())
    if result.isEmpty():
        raise TrainingError("The regression target cannot be read as numbers.")
    return result


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n)``."""
    return df.groupBy(quoted(label).alias("label")).agg(F.count("*").alias("n"))


def can_stratify(df: DataFrame, label: str = "label") -> bool:
    """Whether the rarest class has at least two rows."""
    return (class_sizes(df, label).agg(F.min("n").alias("m")).first()["m"] or 0) >= 2


def test_quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """``(label, total, quota)``: test rows per class, ``ceil(n * test_size)`` in all, by largest
    remainder (then the smaller class)."""
    sizes = cut_lineage(class_sizes(df, label))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    wanted = math.ceil(n * test_size)
    shared = sizes.select(
        "label", "n", F.expr(f"{wanted} * n div {max(n, 1)}").alias("base"), F.expr(f"{wanted} * n % {max(n, 1)}").alias("rest")
    )
    left = wanted - (shared.agg(F.sum("base")).first()[0] or 0)
    one = shared.orderBy(F.desc("rest"), "label").limit(left).select("label", F.lit(1).alias("one"))
    given = null_safe_join(shared, one, ["label"], "left")
    return given.select("label", F.col("n").alias("total"), (F.col("base") + F.coalesce("one", F.lit(0))).alias("quota"))


#: Thresholds that are broadcast; more classes than that meet their rows by a shuffle.
BROADCAST_CLASSES = 100_000


def _with_thresholds(df: DataFrame, label: str | None, key: list[str], seed: int, quotas: DataFrame) -> DataFrame:
    """Add ``_h``, the row's place in the random order of its class, and ``_bounds``, the places of the
    rows that ``quotas (label, total, quota)`` names by rank: several quotas of a class give an array.

    Only counts of hash cells and the rows of the cells that hold a named rank travel; whole rows stay
    where they are.
    """
    group = F.struct(quoted(label) if label else F.lit(0))
    place = F.struct(order_hash(key, seed).alias("h"), *[quoted(k).alias(f"k{i}") for i, k in enumerate(key)])
    narrow = df.select(group.alias("g"), place.alias("place")).withColumn("cell", F.shiftright("place.h", HASH_BITS - CELL_BITS))
    counts = narrow.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("g").orderBy("cell")
    cells = counts.select("g", "cell", "n", (F.sum("n").over(along) - F.col("n")).alias("before"))
    wanted = quotas.select(F.struct("label").alias("g"), "quota").filter("quota > 0")
    ends = cells.join(wanted, "g").filter("before < quota and quota <= before + n")
    ends = cut_lineage(ends.select("g", "cell", "quota", (F.col("quota") - F.col("before")).alias("rank")))
    few = ends.select("g", "cell").distinct()
    near = narrow.join(F.broadcast(few) if few.count() <= BROADCAST_CLASSES else few, ["g", "cell"])
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("g", "cell").orderBy("place")))
    bounds = ranked.join(ends, ["g", "cell", "rank"]).groupBy("g").agg(F.sort_array(F.collect_list("place")).alias("_bounds"))
    bounds = cut_lineage(bounds)
    placed = df.withColumn("g", group).withColumn("_h", place)
    return placed.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_CLASSES else bounds, "g", "left").drop("g")


def assign_split(
    df: DataFrame,
    *,
    test_size: float = 0.2,
    label: str | None = None,
    key: list[str] | None = None,
    seed: int = 42,
    out: str = "is_test",
) -> DataFrame:
    """Add ``is_test`` to ``ceil(n * test_size)`` rows; with ``label``, in proportion per class.

    With ``key``, columns that tell the rows apart, rows are marked where they are: by comparison
    with the last test row of their class. Without, equal rows are numbered first.
    """
    if not 0 < test_size < 0.9:
        raise TrainingError("test_size must lie between 0 and 0.9.")
    if key is None:
        return _numbered_split(df, test_size, label, seed, out)
    quotas = test_quotas(df, label, test_size) if label else _whole_quotas(df, lambda n: [math.ceil(n * test_size)])
    marked = _with_thresholds(df, label, key, seed, quotas)
    hit = F.coalesce(F.col("_h") <= F.get("_bounds", F.lit(0)), F.lit(False))
    return marked.select(*[quoted(c) for c in df.columns], hit.alias(out))


def _whole_quotas(df: DataFrame, ranks: Callable[[int], list[int]]) -> DataFrame:
    """Quotas of a table without classes, from its number of rows."""
    n = df.count()
    return df.sparkSession.createDataFrame([(0, n, r) for r in ranks(n)], "label int, total bigint, quota bigint")


def _numbered_split(df: DataFrame, test_size: float, label: str | None, seed: int, out: str) -> DataFrame:
    if label is None:
        numbered = hash_numbered(df, seed=seed)
        quota = F.ceil(F.col("_total") * F.lit(test_size))
        return numbered.withColumn(out, F.col("_number") < quota).drop("_number", "_total")
    quotas = test_quotas(df, label, test_size).select(F.col("label").alias(label), F.col("quota").alias("_quota"))
    numbered = null_safe_join(hash_numbered(df, by=[quoted(label)], seed=seed), quotas, [label], "left")
    return numbered.withColumn(out, F.col("_number") < F.col("_quota")).select(*[quoted(c) for c in df.columns], out)


def train_test_split(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of :func:`assign_split`."""
    marked = assign_split(df, out="_is_test", **options)
    return (
        marked.filter(~F.col("_is_test")).drop("_is_test"),
        marked.filter(F.col("_is_test")).drop("_is_test"),
    )


def effective_folds(df: DataFrame, folds: int, label: str | None = None) -> int:
    """Folds bounded by the rarest class (or the row count), never below two."""
    if label is None:
        bound = df.count()
    else:
        bound = class_sizes(df, label).agg(F.min("n").alias("m")).first()["m"] or 0
    return max(2, min(folds, bound))


def assign_folds(
    df: DataFrame,
    *,
    folds: int = 3,
    label: str | None = None,
    key: list[str] | None = None,
    seed: int = 42,
    out: str = "fold",
) -> DataFrame:
    """Add a fold number. With ``label``, each class is dealt out evenly over the folds.

    Without ``label`` the folds are consecutive stretches of the hash order, whose sizes differ
    by at most one.
    """
    if key is not None and label is None:
        quotas = _whole_quotas(df, lambda n: [-(-n * f // folds) for f in range(1, folds)])
        marked = _with_thresholds(df, None, key, seed, quotas)
        passed = F.size(F.filter("_bounds", lambda b: F.col("_h") > b))
        return marked.select(*[quoted(c) for c in df.columns], F.coalesce(passed, F.lit(0)).cast("int").alias(out))
    by = [quoted(label)] if label else None
    numbered = hash_numbered(df, by=by, key=key, seed=seed)
    if label:
        fold = F.pmod(F.col("_number"), F.lit(folds))
    else:
        fold = F.floor(F.col("_number") * folds / F.col("_total"))
    return numbered.withColumn(out, fold.cast("int")).drop("_number", "_total")


def feature_schema(df: DataFrame, target: str | None = None) -> list[dict[str, str]]:
    """Name and type of every input column, in order."""
    return [
        {"name": f.name, "dtype": f.dataType.simpleString()}
        for f in df.schema.fields
        if f.name != target
    ]


def feature_schema_json(df: DataFrame, target: str | None = None) -> str:
    """:func:`feature_schema` as JSON text, the form stored with a run."""
    return json.dumps(feature_schema(df, target))


def prepare_target(
    df: DataFrame, target: str, task: str, keep_null: bool = False
) -> tuple[DataFrame, list[str] | None]:
    """Add ``label`` for the task; also return the class names of a classification."""
    if target not in df.columns:
        raise TrainingError(f"Target column {target!r} not found.")
    df = normalise_missing(df)
    if task == "classification":
        names = class_names(df, target, keep_null)
        return encode_labels(df, target, names, keep_null), names
    if task == "regression":
        return numeric_target(df, target), None
    raise TrainingError(f"Task {task!r} is not supported.")
