"""Numbers for categories, however many there are.

The distinct values of all columns are sorted over the cluster by ranges, each range knows how many
come before it, and so every value gets its place in the sorted list of its column without any list on
the driver. Rows meet the numbers by a join: a broadcast one up to a counted bound, a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.scalars import normalise_missing, quoted
from tablewright.session import cut_lineage

#: Values that are broadcast to the rows; more of them meet the rows by a shuffle.
BROADCAST_VALUES = 200_000
_IN_PARTITION = (1 << 33) - 1  # of Spark's increasing numbers: the place inside a partition


def as_category(df: DataFrame, name: str) -> Column:
    """A column as text; booleans read True and False."""
    text = quoted(name).cast("string")
    return F.initcap(text) if isinstance(df.schema[name].dataType, T.BooleanType) else text


def sorted_numbers(values: DataFrame, group: str, value: str) -> DataFrame:
    """``group, value, position``: of each group the distinct values, numbered from 0 in their order.
    NULL values have no number."""
    distinct = values.select(quoted(group).alias(group), quoted(value).alias(value)).filter(quoted(value).isNotNull()).distinct()
    order = [quoted(group), quoted(value)]
    ranged = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row a partition
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    numbered = placed.withColumn("_part", part).join(offsets, "_part").withColumn("_place", F.col("_before") + F.col("_m").bitwiseAND(_IN_PARTITION))
    first = F.broadcast(numbered.groupBy(quoted(group)).agg(F.min("_place").alias("_first")))  # a row a group
    return numbered.join(first, group).select(quoted(group), quoted(value), (F.col("_place") - F.col("_first")).alias("position"))


class CategoryNumbers:
    """The sorted values of some columns, as a table ``column, value, position``."""

    def __init__(self, table: DataFrame, columns: list[str]):
        self.table, self.columns = table, columns
        sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
        self.sizes = [sizes.get(c, 0) for c in columns]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> CategoryNumbers:
        """Of text and boolean columns; missing values are no category."""
        clean = normalise_missing(df)
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_category(clean, c).alias("value")) for c in columns]))
        return cls(cut_lineage(sorted_numbers(clean.select(cells.alias("c")).select("c.*"), "column", "value")), columns)

    def save(self, path: str) -> None:
        self.table.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: list[str]) -> CategoryNumbers:
        return cls(spark.read.parquet(path), columns)

    def names(self) -> DataFrame:
        """``index, name`` of the one-hot features, in their order."""
        starts = F.create_map(*[x for c, n in zip(self.columns, self._starts(), strict=True) for x in (F.lit(c), F.lit(n))])
        return self.table.select(
            (starts[F.col("column")] + F.col("position")).alias("index"), F.concat(F.lit("categorical__"), "column", F.lit("_"), "value").alias("name")
        )

    def _starts(self) -> list[int]:
        return [sum(self.sizes[:i]) for i in range(len(self.columns))]

    def ordinal(self, df: DataFrame, out: str = "ord_") -> DataFrame:
        """Add ``out`` + column for each column: the place of its value, -1 for an unknown or missing one."""
        names = [f"{out}{c}" for c in self.columns]
        rows = normalise_missing(df)
        for column, name, size in zip(self.columns, names, self.sizes, strict=True):
            own = self.table.filter(F.col("column") == column).select(F.col("value").alias("_value"), F.col("position").alias("_position"))
            joined = rows.withColumn("_value", as_category(rows, column)).join(F.broadcast(own) if size <= BROADCAST_VALUES else own, "_value", "left")
            rows = joined.withColumn(name, F.coalesce("_position", F.lit(-1))).drop("_value", "_position")
        return rows.select(*[quoted(c) for c in df.columns], *[quoted(n) for n in names])

    def onehot(self, df: DataFrame, out: str = "hot") -> DataFrame:
        """Add the sparse one-hot form of each row: ``out``, the places of its ones among all features;
        unknown and missing values have none. There are ``sum(sizes)`` features."""
        coded = self.ordinal(df, "_ord_")
        places = [F.when(F.col(f"`_ord_{c}`") >= 0, F.col(f"`_ord_{c}`") + n) for c, n in zip(self.columns, self._starts(), strict=True)]
        ones = F.filter(F.array(*places), lambda p: p.isNotNull())
        return coded.select(*[quoted(c) for c in df.columns], ones.alias(out))
