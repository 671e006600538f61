"""Mixing sources to target weights by balanced sampling with the cube method.

A document's expected number of copies is its source's target over its source's size. The whole
part is taken for sure; the fractions are rounded by the cube method (Deville and Tillé, 2004;
one window of units at a time as in Chauvet and Tillé, 2006): the fractions of three undecided
documents move along the null space of the balancing equations, which keeps the source's
expected tokens and documents exactly, until one of them is decided. Blocks of a source run
apart; the two documents that a block leaves undecided meet in a next round of blocks, and only
the last two of a source are landed by hand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import WORD_PATTERN, join_hot, packed, unpacked
from tablewright.operators.ordering import hash_numbered, number_copies
from tablewright.session import cut_lineage

#: Weights of the sources in their order, the mix's size and the cap of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK_ROWS = 4_000
_EPS = 1e-9


def flight(fractions: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Move fractions to 0 or 1, but for at most two; the sums of fractions and of fractions times
    sizes stay as they are, and each fraction is the probability of a 1."""
    p = fractions.tolist()
    x = sizes.tolist()
    open_units = [i for i, v in enumerate(p) if _EPS < v < 1 - _EPS]
    draws = random.random(len(open_units) + 3).tolist()
    window: list[int] = []
    for unit in open_units:
        window.append(unit)
        if len(window) < 3:
            continue
        a, b, c = window
        u, v, w = x[c] - x[b], x[a] - x[c], x[b] - x[a]
        if u == 0 and v == 0 and w == 0:
            u, v = 1.0, -1.0  # all of one size: two of them trade
        up = down = math.inf
        for i, d in ((a, u), (b, v), (c, w)):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if draws.pop() * (up + down) < down else -down
        for i, d in ((a, u), (b, v), (c, w)):
            p[i] += step * d
        left = [i for i in window if _EPS < p[i] < 1 - _EPS]
        for i in window:
            if i not in left:
                p[i] = float(round(p[i]))
        window = left
    return np.array(p)


def land(fractions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decide what the flight left (a few units): the choice nearest to the expected tokens, then
    documents."""
    p = fractions.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    tokens, documents = float((p[left] * sizes[left]).sum()), float(p[left].sum())
    best = min(
        range(1 << len(left)),
        key=lambda m: (
            abs(sum(float(sizes[i]) for k, i in enumerate(left) if m >> k & 1) - tokens),
            abs(m.bit_count() - documents), m,
        ),
    )
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    return np.round(p)


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, n_docs, target`` for rows ``source, size``.

    Sources in code point order, a null source last, weigh ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``most`` times its source's size; the excess goes
    to the others by weight, until none is above. With the sources ordered by that cap over
    weight, the level that all uncapped sources reach follows from sums before and after each.
    The unpartitioned windows have a row a source, not a document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    s = by_source.withColumn("weight", F.array(*map(F.lit, weights))[turn].cast("double"))
    s = s.withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("rank", F.row_number().over(by_level))
    first = F.min(F.when(F.col("fits"), F.struct("rank", "level"))).over(everything)
    final = first["level"]  # of the first source that stays under its cap
    target = F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def _flown(rows: DataFrame, block: Column, last: bool) -> DataFrame:
    """One round: every block of a source in its own flight."""

    def fly(table: pa.Table) -> pa.Table:
        # large documents first, so that small ones are left to be landed
        order = np.lexsort((table["doc_id"].fill_null(-(2**63)).to_numpy(), table["place"].to_numpy(), -table["size"].to_numpy()))
        table = table.take(pa.array(order))
        p, x = table["p"].to_numpy(), table["size"].to_numpy().astype(float)
        seed = int(np.bitwise_xor.reduce(table["place"].to_numpy().astype(np.int64).view(np.uint64) + np.uint64(len(p))))
        p = flight(p, x, np.random.Generator(np.random.PCG64(seed)))
        if last:
            p = land(p, x)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p)).drop_columns(["block"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("block", block).groupBy("source", "block").applyInArrow(fly, out)


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row a document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` is the number of words (null text: 0). A row is taken ``copies`` times, at most
    ``most`` times rounded up. Null ids and repeated rows are documents of their own; a source
    whose texts have no words has target 0. All draws are seeded by the ids, so reruns agree.
    """
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size"))
    rows = cut_lineage(number_copies(rows, "copy"))  # rows alike in all three fall into different blocks
    targets = cut_lineage(source_targets(rows.select("source", "size"), weights=weights, share=share, most=most))
    rows = rows.withColumn("known", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    targets = targets.withColumn("known", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    # a rate a hair under a whole number is that number
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"), 12)).otherwise(F.lit(0.0))
    rows = join_hot(rows, targets, ["source", "known"]).withColumn("rate", rate)
    rows = rows.withColumn("p", F.col("rate") - F.floor("rate")).withColumn("whole", F.floor("rate").cast("long"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "size", "copy", F.lit(17))).drop("rate", "copy")
    # blocks of known size: one more round leaves a block_rows-th part of the undecided rows
    blocks = F.ceil(F.col("n_docs") / block_rows)
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    source = F.when(F.col("known"), F.concat(F.lit("+"), "source")).otherwise(F.lit("-"))
    rows = rows.withColumn("name", F.col("source")).withColumn("source", source)
    done, n = None, most_docs
    while True:
        last = n <= block_rows
        flown = cut_lineage(_flown(rows, F.pmod(F.xxhash64("place", F.lit(n)), blocks) if not last else F.lit(0).cast("long"), last))
        decided = flown.filter((F.col("p") == 0) | (F.col("p") == 1))
        done = decided if done is None else done.unionByName(decided)
        if last:
            break
        rows = flown.filter((F.col("p") > 0) & (F.col("p") < 1))
        n = math.ceil(n / block_rows) * 2
        blocks = F.ceil(blocks * 2 / block_rows)
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select(
        "doc_id", F.when(F.col("known"), F.col("name")).alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns as they were.

    Rows that share id, source and size share their copies: together they are taken as often as
    the mix takes them, and no row more than one time oftener than another. Rows without words, null
    ids and null sources are treated as in ``mix_sources``; an empty table stays empty; columns may
    have any names.
    """
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    rates = cut_lineage(mixed.groupBy(F.struct("doc_id", "source", "size").alias("place")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")
    ))
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    place = F.struct(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size")
    )
    held = packed(docs, place.alias("place"))
    # a row a document: its files are far smaller than what a broadcast of it would hold
    once = rates.filter("copies > 0 and alike = 1").hint("merge")
    one = held.join(once, "place").select("row", "copies")
    several = rates.filter("copies > 0 and alike > 1")
    if not several.isEmpty():  # rows alike in all three take turns in a random order
        numbered = hash_numbered(held.join(several.select("place"), "place", "left_semi"), by=[F.col("place")], number="turn", total="n")
        shared = join_hot(numbered, several, ["place"])
        more = F.when(F.col("turn") < F.col("copies") % F.col("alike"), 1).otherwise(0)
        one = one.unionByName(shared.select("row", (F.floor(F.col("copies") / F.col("alike")) + more).alias("copies")))
    return unpacked(one.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))))
