"""Exact quantiles that never hold a whole column in one task.

Spark's ``percentile`` keeps every distinct value of a column in one buffer. Here a sketch brackets
each wanted rank, a scan counts what lies below and inside the bracket, and the bracket is narrowed
until it holds few rows; the exact order statistics are then read from the counted values of those.
A column of few rows is one bracket from the start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.scalars import quoted

BRACKET_ROWS = 200_000
SKETCH_ACCURACY = 10_000
COLUMNS_PER_SCAN = 40


@dataclass
class _Bracket:
    column: str
    rank: int  # 0-based position among the non-null values
    low: float
    high: float
    below: int = 0
    inside: int = 0

    def holds(self, value: Column) -> Column:
        return value.between(self.low, self.high)

    def settled(self) -> bool:
        return self.low == self.high or self.inside <= BRACKET_ROWS


def _batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    *,
    accuracy: int | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, per column; ``None`` for a column without values.

    ``accuracy`` switches to the sketch alone (``percentile_approx``).
    """
    if not columns:
        return {}
    if accuracy is not None:
        return _one_pass(
            df, columns, probabilities, lambda c: F.percentile_approx(c, probabilities, accuracy)
        )
    return _by_brackets(df, columns, probabilities)


def _one_pass(df, columns, probabilities, expression) -> dict[str, list[float | None]]:
    result: dict[str, list[float | None]] = {}
    for batch in _batches(columns, COLUMNS_PER_SCAN):
        row = df.agg(
            *[expression(quoted(c).cast("double")).alias(f"q{i}") for i, c in enumerate(batch)]
        ).first()
        for i, name in enumerate(batch):
            values = row[f"q{i}"]
            result[name] = [None] * len(probabilities) if values is None else list(values)
    return result


def _by_brackets(df, columns, probabilities) -> dict[str, list[float | None]]:
    sizes: dict[str, int] = {}
    for batch in _batches(columns, COLUMNS_PER_SCAN):
        row = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(batch)]).first()
        sizes.update({c: row[f"n{i}"] for i, c in enumerate(batch)})
    wanted: dict[str, set[int]] = {c: set() for c in columns}
    for c in columns:
        for p in probabilities:
            if sizes[c]:
                position = p * (sizes[c] - 1)
                wanted[c] |= {math.floor(position), math.ceil(position)}
    brackets = [
        _Bracket(c, rank, -math.inf, math.inf, 0, sizes[c])
        for c in columns
        for rank in sorted(wanted[c])
    ]
    for batch in _batches(columns, COLUMNS_PER_SCAN):
        _first_brackets(df, [b for b in brackets if b.column in batch and not b.settled()])
    statistics = order_statistics(df, brackets)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        if not sizes[c]:
            result[c] = [None] * len(probabilities)
            continue
        values = []
        for p in probabilities:
            position = p * (sizes[c] - 1)
            low = statistics[c, math.floor(position)]
            high = statistics[c, math.ceil(position)]
            values.append(low + (high - low) * (position - math.floor(position)))
        result[c] = values
    return result


def order_statistics(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """The value at each bracket's rank, by repeated narrowing."""
    open_brackets = [b for b in brackets if not b.settled()]
    while open_brackets:
        for batch in _batches(open_brackets, COLUMNS_PER_SCAN):
            _narrow(df, batch)
        open_brackets = [b for b in brackets if not b.settled()]
    found = {(b.column, b.rank): b.low for b in brackets if b.low == b.high}
    rest = [b for b in brackets if b.low != b.high]
    for batch in _batches(rest, COLUMNS_PER_SCAN):
        found.update(_read_off(df, batch))
    return found


def _shares(b: _Bracket) -> tuple[float, float]:
    """Sketch probabilities that surely enclose the bracket's rank."""
    margin = 2.0 / SKETCH_ACCURACY
    share = (b.rank - b.below) / max(1, b.inside - 1)
    return max(0.0, share - margin), min(1.0, share + margin)


def _first_brackets(df: DataFrame, batch: list[_Bracket]) -> None:
    """First narrowing: all brackets of a column read from one sketch of the whole column."""
    if not batch:
        return
    columns = list(dict.fromkeys(b.column for b in batch))
    wanted = {c: [p for b in batch if b.column == c for p in _shares(b)] for c in columns}
    row = df.agg(
        *[
            f.alias(f"{kind}{i}")
            for i, c in enumerate(columns)
            for kind, f in (
                ("e", F.percentile_approx(quoted(c).cast("double"), wanted[c], SKETCH_ACCURACY)),
                ("lo", F.min(quoted(c).cast("double"))),
                ("hi", F.max(quoted(c).cast("double"))),
            )
        ]
    ).first()
    ends = {c: iter(row[f"e{i}"]) for i, c in enumerate(columns)}
    limits = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    tries = [(next(ends[b.column]), next(ends[b.column]), *limits[b.column]) for b in batch]
    _recount(df, batch, tries)


def _narrow(df: DataFrame, batch: list[_Bracket]) -> None:
    """Shrink every bracket to the part that a sketch of its rows cannot tell apart."""
    ends = []
    for i, b in enumerate(batch):
        value = F.when(b.holds(quoted(b.column).cast("double")), quoted(b.column).cast("double"))
        ends += [
            F.percentile_approx(value, list(_shares(b)), SKETCH_ACCURACY).alias(f"e{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
        ]
    row = df.agg(*ends).first()
    _recount(df, batch, [(*row[f"e{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(batch))])


def _recount(df: DataFrame, batch: list[_Bracket], tries: list[tuple]) -> None:
    """Count below and inside the proposed brackets, and accept or correct them."""
    counts, bounds = [], []
    for i, (b, (low, high, least, most)) in enumerate(zip(batch, tries, strict=True)):
        first, last = _shares(b)
        low, high = float(least if first == 0.0 else low), float(most if last == 1.0 else high)
        bounds.append((low, high))
        value = quoted(b.column).cast("double")
        counts += [
            F.count_if(value < F.lit(low)).alias(f"b{i}"),
            F.count_if(value.between(low, high)).alias(f"i{i}"),
        ]
    row = df.agg(*counts).first()
    for i, (b, (low, high)) in enumerate(zip(batch, bounds, strict=True)):
        below, inside = row[f"b{i}"], row[f"i{i}"]
        if b.rank < below:  # the sketch missed: the value lies left of the bracket
            b.high = math.nextafter(low, -math.inf)
            b.inside = below - b.below
        elif b.rank >= below + inside:  # or right of it
            b.low = math.nextafter(high, math.inf)
            b.inside = b.below + b.inside - below - inside
            b.below = below + inside
        elif inside == b.inside:  # nothing gained: halve the value range
            _halve(df, b, low, high)
        else:
            b.low, b.high, b.below, b.inside = low, high, below, inside


def _halve(df: DataFrame, b: _Bracket, low: float, high: float) -> None:
    middle = low + (high - low) / 2
    value = quoted(b.column).cast("double")
    left = df.agg(F.count_if(value.between(low, middle)).alias("n")).first()["n"]
    if b.rank < b.below + left:
        b.low, b.high, b.inside = low, middle, left
    else:
        b.low, b.high = math.nextafter(middle, math.inf), high
        b.below, b.inside = b.below + left, b.inside - left


def _read_off(df: DataFrame, batch: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Count the few values inside the brackets and pick those at the wanted ranks.

    Ranks that share a bracket share its values. A value comes back only if it is at a rank.
    """
    places: dict[tuple, list[int]] = {}
    for b in batch:
        places.setdefault((b.column, b.low, b.high, b.below), []).append(b.rank - b.below)
    brackets = list(places)
    values = [quoted(c).cast("double") for c, *_ in brackets]
    inside = [v.between(low, high) for v, (_, low, high, _) in zip(values, brackets, strict=True)]
    cells = [
        F.struct(F.lit(i).alias("id"), F.when(near, v).alias("v"))
        for i, (v, near) in enumerate(zip(values, inside, strict=True))
    ]
    tagged = df.filter(reduce(lambda a, b: a | b, inside)).select(F.explode(F.array(*cells)).alias("t"))
    counts = tagged.select("t.*").filter("v is not null").groupBy("id", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("v"))
    ranks = F.array(*[F.array(*[F.lit(r).cast("bigint") for r in sorted(places[b])]) for b in brackets])
    rows = (
        counts.withColumn("upto", upto)
        .withColumn("ranks", F.filter(
            ranks[F.col("id")], lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))
        ))
        .filter(F.size("ranks") > 0)
        .collect()
    )
    found = {}
    for r in rows:
        column, _, _, below = brackets[r["id"]]
        found.update({(column, below + rank): r["v"] for rank in r["ranks"]})
    return found
