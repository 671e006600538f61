"""Numbering and running totals without a single-task global window.

A plain ``row_number`` over one big group sorts that group in one task. Here each group is cut
into cells first: by a hash for a random order, by value ranges for a real order. The cells are
counted (with map-side combine), the counts become offsets through a window over at most
``MAX_CELLS`` rows per group, and the final window works inside one cell only.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.scalars import order_hash, quoted
from tablewright.session import cut_lineage

HASH_BITS = 60
CELL_BITS = 16
MAX_CELLS = 1 << CELL_BITS
COPIES_PER_TASK_ROW = 100_000
RANGE_CELLS = 10_000
ROWS_PER_RANGE_CELL = 500_000  # sets the number of cells, never the method


def number_copies(df: DataFrame, out: str = "_copy") -> DataFrame:
    """Number equal rows 0, 1, 2, …, so that every row has its own key.

    Equal rows are first packed into one row with a count (map-side combine), then unpacked.
    A row with very many copies is unpacked in blocks that are spread over tasks.
    """
    columns = [quoted(name) for name in df.columns]
    packed = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    few = packed.filter(F.col("_n") <= COPIES_PER_TASK_ROW).select(
        *columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias(out)
    )
    blocks = packed.filter(F.col("_n") > COPIES_PER_TASK_ROW).select(
        *columns,
        "_n",
        F.explode(
            F.sequence(
                F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES_PER_TASK_ROW)
            )
        ).alias("_block"),
    )
    start = F.col("_block") * COPIES_PER_TASK_ROW
    many = blocks.repartition(*columns, F.col("_block")).select(
        *columns,
        F.explode(
            F.sequence(start, F.least(F.col("_n"), start + COPIES_PER_TASK_ROW) - 1)
        ).alias(out),
    )
    return few.unionByName(many)


def hash_numbered(
    df: DataFrame,
    *,
    by: list[Column] | None = None,
    key: list[str] | None = None,
    seed: int = 42,
    number: str = "_number",
    total: str = "_total",
) -> DataFrame:
    """Number the rows of each group 0 … n-1 in a seeded pseudo-random order; add the group size.

    ``key`` names columns that identify a row; without it equal rows are told apart by
    :func:`number_copies`. The result depends on values and seed only.
    """
    columns = list(df.columns)
    if key is None:
        df = number_copies(df)
        key = [*columns, "_copy"]
    group = F.struct(*[g.alias(f"g{i}") for i, g in enumerate(by or [F.lit(0)])])
    hashed = df.withColumn("_hash", order_hash(key, seed)).withColumn(
        "_cell",
        F.struct(
            group.alias("g"),
            F.shiftright("_hash", HASH_BITS - CELL_BITS).alias("b"),
        ),
    )
    counts = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = Window.partitionBy("_cell.g")
    offsets = counts.select(
        "_cell",
        (F.sum("_n").over(cells.orderBy("_cell.b")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(cells).alias(total),
    )
    order = Window.partitionBy("_cell").orderBy("_hash", *[quoted(name) for name in key])
    ranked = hashed.withColumn("_rank", F.row_number().over(order))
    return (
        ranked.join(offsets, "_cell")  # a struct is never NULL itself, and its NULL fields meet
        .select(
            *[quoted(name) for name in columns],
            (F.col("_offset") + F.col("_rank") - 1).cast("bigint").alias(number),
            F.col(total),
        )
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of both sides where NULL meets NULL; the columns appear once."""
    renamed = right.select(*[quoted(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & quoted(c).eqNullSafe(quoted(f"_r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def with_range_cell(df: DataFrame, order: str, n_rows: int, out: str = "_cell") -> DataFrame:
    """Add a cell number that grows with the (double) column ``order``: NULL first, NaN last.

    The edges are approximate quantiles, so the cells are about equally full however the values
    are spread. At most ``RANGE_CELLS`` numbers reach the driver. Rows should be distinct in
    ``order``, or few per value.
    """
    probabilities = [i / RANGE_CELLS for i in range(1, RANGE_CELLS)]
    wanted = min(RANGE_CELLS, n_rows // ROWS_PER_RANGE_CELL + 1)
    step = RANGE_CELLS // wanted
    value = quoted(order)
    plain = F.when(~F.isnan(value), value)
    edges = df.agg(
        F.percentile_approx(plain, probabilities[step - 1 :: step], 2 * RANGE_CELLS)
    ).first()[0]
    infinity = float("inf")
    inside = sorted({e for e in edges or [] if abs(e) < infinity}) or [0.0]
    cells = Bucketizer(
        splits=[-infinity, *inside, infinity], inputCol="_value", outputCol=out
    ).transform(df.withColumn("_value", F.coalesce(plain, F.lit(0.0)))).drop("_value")
    cell = F.when(value.isNull(), -1.0).when(F.isnan(value), float(RANGE_CELLS + 1))
    return cells.withColumn(out, cell.otherwise(F.col(out)))


def running_totals(
    df: DataFrame,
    *,
    order: str,
    sums: list[str],
    by: list[str] | None = None,
    ascending: bool = True,
) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` as ``cum_<name>``, per group ``by``.

    ``df`` must hold one row per group and value of ``order`` (aggregate first). Rows are written
    out once, cut into range cells, summed inside the cells and shifted by the totals of the
    cells before; the number of rows sets the number of cells only. A NULL in ``order`` is the
    lowest value and NaN the highest; NULL is a group like any other.
    """
    by = by or []
    along = F.col(order).asc() if ascending else F.col(order).desc()
    stored = cut_lineage(df)
    celled = with_range_cell(stored, order, stored.count())
    sign = 1 if ascending else -1
    totals = celled.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    cells = Window.partitionBy(*(by or [F.lit(0)])).orderBy(sign * F.col("_cell"))
    offsets = totals.select(
        *by,
        "_cell",
        *[(F.sum(f"_t_{c}").over(cells) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most RANGE_CELLS + 2 rows
    inside = (
        Window.partitionBy(*by, "_cell")
        .orderBy(along)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = celled.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums])
    return null_safe_join(placed, offsets, [*by, "_cell"]).select(
        *df.columns,
        *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
    )
