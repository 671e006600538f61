"""Exact k nearest neighbours in two rounds.

Of training rows that are alike in all features the k with the smallest labels win every tie, so no
other can ever be among the k nearest: only those are kept, found before anything travels. Those that
are equal are packed into one row with a weight and placed in the cell of their nearest pivot (a
Voronoi partition, as in Lu et al., "Efficient processing of k nearest neighbor joins using
MapReduce", 2012); cells are cut into blocks. There are about as many pivots as distinct features in
a cell, so both grow with the square root of these.

In the first round a query visits one block of its home cell, or its nearest cells until they
hold k rows. The k-th distance found there travels with the query: in the second round it visits
only blocks that may hold something nearer, by the triangle inequality and by the plane between
two pivots, and brings back nothing farther. Small blocks that lie along each other are visited
together. Inside a task queries and distinct points meet as matrices: a product rules out what is
farther for certain, the rest is measured by differences. There is one way at every size.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.scalars import order_hash
from tablewright.session import cut_lineage

BLOCK_ROWS = 5_000
GROUP_ROWS = 2_000
QUERY_ROWS = 20_000
DISTANCES_AT_ONCE = 4_000_000


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences (exact zeros for equal rows)."""
    result = np.empty((len(queries), len(points)))
    step = max(1, DISTANCES_AT_ONCE // max(1, points.size))
    for start in range(0, len(queries), step):
        part = queries[start : start + step, None, :] - points[None, :, :]
        result[start : start + step] = np.sqrt(np.einsum("qpd,qpd->qp", part, part))
    return result


def _spread(queries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and how far those of each query may be off."""
    centre = points.mean(axis=0)
    q, p = queries - centre, points - centre
    size_q, size_p = np.einsum("qd,qd->q", q, q), np.einsum("pd,pd->p", p, p)
    off = 1e-12 * (queries.shape[1] + 1) * (size_q + size_p.max() + np.abs(centre).max() ** 2)
    squares = q @ p.T
    squares *= -2
    squares += size_q[:, None]
    squares += size_p[None, :]
    return squares, off


def _near_pairs(queries: np.ndarray, points: np.ndarray, limit: np.ndarray, k: int):
    """Pairs of which at least the k nearest copies within the limits are part, with their distances:
    a matrix product rules out what is farther for certain, the rest is measured by differences."""
    if not (np.isfinite(queries).all() and np.isfinite(points).all()):
        d = _distances(queries, points)
        row, column = np.nonzero(d <= limit[:, None])
        return row, column, d[row, column]
    squares, off = _spread(queries, points)
    most = limit * limit * (1 + 1e-9) + off
    if len(points) > k:
        most = np.minimum(most, np.partition(squares, k - 1, axis=1)[:, k - 1] + 2 * off)
    row, column = np.nonzero(squares <= most[:, None])
    del squares
    d = np.empty(len(row))
    step = max(1, DISTANCES_AT_ONCE // max(1, queries.shape[1]))
    for start in range(0, len(row), step):
        part = queries[row[start : start + step]] - points[column[start : start + step]]
        d[start : start + step] = np.sqrt(np.einsum("nd,nd->n", part, part))
    return row, column, d


def _nearest_pivot(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the nearest pivot, the first of several."""
    cell, reach = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.nan)
    step = max(1, DISTANCES_AT_ONCE // len(pivots))
    for start in range(0, len(vectors), step):
        some = vectors[start : start + step]
        row, column, d = _near_pairs(some, pivots, np.full(len(some), np.inf), 1)
        order = np.lexsort((column, d, row))
        first = order[np.diff(row[order], prepend=-1) > 0]
        cell[start + row[first]], reach[start + row[first]] = column[first], d[first]
    return cell, reach


def _kept_copies(row: np.ndarray, column: np.ndarray, d: np.ndarray, labels: np.ndarray, weights: np.ndarray, k: int):
    """Of the pairs of each row the nearest copies, k in all; ties go to the smaller label."""
    order = np.lexsort((labels[column], d, row))
    row, column, d = row[order], column[order], d[order]
    held = np.cumsum(weights[column])
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else np.zeros(0, int)
    before = held - weights[column] - (held[start] - weights[column][start])
    keep = before < k
    return row[keep], column[keep], d[keep], np.minimum(weights[column][keep], k - before[keep])


def nearest_copies(distances: np.ndarray, limit: np.ndarray, labels: np.ndarray, weights: np.ndarray, k: int):
    """Of each row of a matrix the nearest copies of its columns, k in all, none beyond the row's
    limit; ties go to the smaller label. Returns rows, columns and usable weights."""
    if distances.shape[1] > k:
        limit = np.minimum(limit, np.partition(distances, k - 1, axis=1)[:, k - 1])
    row, column = np.nonzero(distances <= limit[:, None])
    row, column, _, copies = _kept_copies(row, column, distances[row, column], labels, weights, k)
    return row, column, copies


class NearestNeighbours:
    """A fitted model: placed training rows, their pivots, and the voting rule."""

    def __init__(self, points: DataFrame, pivots: np.ndarray, blocks: list[tuple], *, k: int, weighting: str, n_classes: int):
        self.points = points  # (x, y, w, cell, block), distinct in (x, y), of each x k copies at most
        self.pivots, self.blocks = pivots, blocks  # blocks: (cell, block, rows, copies, reach)
        self.k, self.weighting, self.n_classes = k, weighting, n_classes

    @classmethod
    def fit(cls, df: DataFrame, *, k: int = 5, weighting: str = "uniform", n_classes: int = 0,
            features: str = "features", label: str = "label") -> NearestNeighbours:
        """Pack and place the training rows; ``n_classes`` 0 means regression."""
        rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
        # numbers are sorted faster than arrays
        alike = Window.partitionBy("number", "x").orderBy(F.col("y").asc_nulls_last())
        usable = rows.withColumn("number", F.xxhash64("x")).withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= k)
        packed = cut_lineage(
            usable.groupBy("number", "x", "y")
            .agg(F.count("*").alias("w"), (F.min("place") == 1).alias("head"))  # one head for each x
            .select("x", "y", "w", "head", order_hash(["x"], 1).alias("h"))
        )
        heads = packed.filter("head").select("x", "h")
        wanted = max(1, math.isqrt(heads.count()))
        pivots = np.array([r["x"] for r in heads.orderBy("h", "x").limit(wanted).collect()])
        placed = cut_lineage(packed.select("x", "y", "w", "h", _home(pivots)("x").alias("p")).select("x", "y", "w", "h", "p.*"))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        # a hot cell is cut by hash, so that each block is a sample of it
        parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts")))  # a row a pivot
        placed = cut_lineage(
            placed.join(parts, "cell").select("x", "y", "w", "cell", F.pmod("h", "parts").cast("int").alias("block"), "reach")
        )
        return cls(placed.drop("reach"), pivots, _blocks(placed), k=k, weighting=weighting, n_classes=n_classes)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``prediction`` (and ``probability`` for classes); each distinct query is answered once."""
        asked = df.withColumn("_x", vector_to_array(features))
        votes = self._votes(asked.select(F.col("_x").alias("q")).distinct()).withColumnRenamed("q", "_x")
        voted = asked.join(votes, "_x", "left").drop("_x")
        if not self.n_classes:
            return voted.withColumn("prediction", F.get("_vote", F.lit(0))).drop("_vote")
        best = F.array_position("_vote", F.array_max("_vote")) - 1
        return (
            voted.withColumn("probability", array_to_vector("_vote"))
            .withColumn("prediction", best.cast("double"))
            .drop("_vote")
        )

    def _votes(self, queries: DataFrame) -> DataFrame:
        route = _Route(self.pivots, self.blocks, self.k, GROUP_ROWS)
        first = queries.select("q", F.lit(float("inf")).alias("bound"), F.explode(route.first()("q")).alias("place"))
        near = cut_lineage(self._visit(first, route))
        bounds = self._nearest(near).groupBy("q").agg(F.max("d").alias("bound"))
        second = bounds.select("q", "bound", F.explode(route.second()("q", "bound")).alias("place"))
        return self._count_votes(self._nearest(near.unionByName(self._visit(second, route))))

    def visited_blocks(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``q, first, second``: how many blocks each distinct query visits in the two rounds."""
        queries = df.select(vector_to_array(features).alias("q")).distinct()
        route = _Route(self.pivots, self.blocks, self.k)
        first = queries.select("q", F.lit(float("inf")).alias("bound"), F.explode(route.first()("q")).alias("place"))
        bounds = self._nearest(self._visit(first, route)).groupBy("q").agg(F.max("d").alias("bound"))
        return bounds.select("q", F.size(route.first()("q")).alias("first"), F.size(route.second()("q", "bound")).alias("second"))

    def _visit(self, routed: DataFrame, route: _Route) -> DataFrame:
        """The nearest points of each query in each block it visits: ``q, d, y, w``."""
        k = self.k
        routed = cut_lineage(routed)
        asked = routed.groupBy("place").agg(F.count("*").alias("n"))
        salts = asked.select("place", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("salts"))
        names = F.broadcast(  # a row a block
            self.points.sparkSession.createDataFrame(
                [(c, b, int(i)) for (c, b, *_), i in zip(self.blocks, route.group, strict=True)], "cell int, block int, place int"
            )
        )
        salts = cut_lineage(salts)
        train = (
            self.points.join(names, ["cell", "block"])
            .join(F.broadcast(salts), "place")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            .select("place", "salt", "x", "y", "w")
        )
        asked = routed.join(F.broadcast(salts), "place").select(
            "place", F.pmod(F.xxhash64("q"), F.col("salts")).cast("int").alias("salt"), "q", "bound"
        )

        def match(asked: pa.Table, train: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            if asked.num_rows and train.num_rows:
                queries, points = _matrix(asked["q"]), _matrix(train["x"])
                bound = asked["bound"].to_numpy()
                labels, weights = train["y"].to_numpy(), train["w"].to_numpy()
                heads, place = _alike(points)
                order, count = np.argsort(place, kind="stable"), np.bincount(place)
                begin, points = np.cumsum(count) - count, points[heads]
                step = max(1, DISTANCES_AT_ONCE // len(points))
                for start in range(0, len(queries), step):
                    limit = bound[start : start + step]
                    row, column, d = _near_pairs(queries[start : start + step], points, limit, k)
                    within = d <= limit[row]
                    row, column, d = row[within], column[within], d[within]
                    # each point stands for all its labels
                    many = count[column]
                    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    column = order[np.repeat(begin[column], many) + inside]
                    row, column, d, copies = _kept_copies(np.repeat(row, many), column, np.repeat(d, many), labels, weights, k)
                    for held, found in zip(out, (row + start, d, labels[column], copies), strict=True):
                        held.append(found)
            row, d, y, w = (np.concatenate(c) if c else np.zeros(0) for c in out)
            q = asked["q"].combine_chunks().take(pa.array(row.astype(np.int64)))
            return pa.table({"q": q, "d": d.astype(float), "y": y.astype(float), "w": w.astype(np.int64)})

        keys = ["place", "salt"]
        return asked.groupBy(*keys).cogroup(train.groupBy(*keys)).applyInArrow(
            match, "q array<double>, d double, y double, w bigint"
        )

    def _nearest(self, found: DataFrame) -> DataFrame:
        """Of what the blocks of each query gave the k nearest copies; each gave k at most."""
        order = Window.partitionBy("q").orderBy("d", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        used = found.withColumn("_before", F.sum("w").over(order) - F.col("w")).filter(F.col("_before") < self.k)
        return used.withColumn("w", F.least("w", F.lit(self.k) - F.col("_before"))).drop("_before")

    def _count_votes(self, used: DataFrame) -> DataFrame:
        """Mean target, or the share of votes per class. An exact hit outvotes all others."""
        if self.weighting == "distance":
            touching = F.max(F.col("d") == 0).over(Window.partitionBy("q"))
            used = used.withColumn("_touch", touching).withColumn(
                "v",
                F.when(F.col("_touch"), F.when(F.col("d") == 0, F.col("w")).otherwise(0))
                .otherwise(F.try_divide(F.col("w").cast("double"), F.col("d"))),
            )
        else:
            used = used.withColumn("v", F.col("w").cast("double"))
        total = F.sum("v")
        if not self.n_classes:
            return used.groupBy("q").agg(
                F.array(F.sum(F.col("v") * F.col("y")) / total).alias("_vote")
            )
        shares = [
            F.sum(F.when(F.col("y") == c, F.col("v")).otherwise(0.0)) / total
            for c in range(self.n_classes)
        ]
        return used.groupBy("q").agg(F.array(*shares).alias("_vote"))

    def save(self, path: str) -> None:
        """Write the placed rows, the pivots and the rule."""
        self.points.write.mode("errorifexists").parquet(f"{path}/points")
        spark = self.points.sparkSession
        pivots = [(i, p.tolist()) for i, p in enumerate(self.pivots)]
        spark.createDataFrame(pivots, "cell int, x array<double>").write.parquet(f"{path}/pivots")
        rule = {"k": self.k, "weighting": self.weighting, "n_classes": self.n_classes}
        spark.createDataFrame([(json.dumps(rule),)], "value string").coalesce(1).write.text(
            f"{path}/rule"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NearestNeighbours:
        """Read a saved model."""
        rule = json.loads(spark.read.text(f"{path}/rule").first()["value"])
        pivots = np.array([r["x"] for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()])
        points = spark.read.parquet(f"{path}/points")
        placed = points.withColumn("reach", _home(pivots)("x")["reach"])
        return cls(points, pivots, _blocks(placed), **rule)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each distinct row, and for each row the place of its own among these."""
    keys = np.ascontiguousarray(x + 0.0)  # there is one zero
    if not keys.shape[1]:
        return np.zeros(1, int), np.zeros(len(x), int)
    return np.unique(keys.view(np.dtype((np.void, keys.itemsize * keys.shape[1]))).ravel(), return_index=True, return_inverse=True)[1:]


def _home(pivots: np.ndarray):
    @F.pandas_udf("struct<cell:int,reach:double>")
    def home(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": [], "reach": []})
        x = np.stack(vectors.to_numpy())
        heads, place = _alike(x)
        cell, reach = _nearest_pivot(x[heads], pivots)
        return pd.DataFrame({"cell": cell[place], "reach": reach[place]})

    return home


def _blocks(placed: DataFrame) -> list[tuple]:
    """``cell, block, rows, copies, reach`` of every block: a row a block, sorted."""
    found = placed.groupBy("cell", "block").agg(F.count("*").alias("n"), F.sum("w").alias("copies"), F.max("reach").alias("reach"))
    return sorted((r["cell"], r["block"], r["n"], r["copies"], r["reach"]) for r in found.collect())


def _groups(pivots: np.ndarray, blocks: list[tuple], rows: int) -> np.ndarray:
    """The group of each block: small ones that lie along each other on the widest coordinate share
    one of at most ``rows`` rows, so that a query does not travel to each of them."""
    if not rows:
        return np.arange(len(blocks))
    along = pivots[[b[0] for b in blocks], int(np.argmax(pivots.var(axis=0)))]
    group, made, held = np.zeros(len(blocks), int), 0, 0
    for i in np.argsort(along, kind="stable").tolist():
        if held and held + blocks[i][2] > rows:
            made, held = made + 1, 0
        group[i], held = made, held + blocks[i][2]
    return group


class _Route:
    """Which groups of blocks a query visits; blocks are named by their place in the list."""

    def __init__(self, pivots: np.ndarray, blocks: list[tuple], k: int, group_rows: int = 0):
        self.pivots, self.k = pivots, k
        self.group = _groups(pivots, blocks, group_rows)
        self.cell = np.array([b[0] for b in blocks])
        self.copies = np.array([b[3] for b in blocks])
        self.reach = np.array([b[4] for b in blocks])
        # blocks of one cell stand beside each other
        self.cells, self.start = np.unique(self.cell, return_index=True)
        self.end = np.r_[self.start[1:], len(self.cell)]

    def _first(self, vectors: np.ndarray) -> list[list[int]]:
        pivots = self.pivots[self.cells]
        home = _nearest_pivot(vectors, pivots)[0]
        picks = np.abs(vectors).sum(axis=1).view(np.uint64)  # which block of the home cell
        out = []
        for vector, cell, pick in zip(vectors, home.tolist(), picks.tolist(), strict=True):
            start, end = self.start[cell], self.end[cell]
            one = int(start + pick % (end - start))
            if self.copies[one] >= self.k:
                out.append([one])
                continue
            taken, held = [], 0
            for c in np.argsort(_distances(vector[None], pivots)[0], kind="stable"):
                taken += range(self.start[c], self.end[c])
                held += self.copies[self.start[c] : self.end[c]].sum()
                if held >= self.k:
                    break
            out.append([int(i) for i in taken])
        return out

    def first(self):
        @F.pandas_udf("array<int>")
        def visits(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series([self._grouped(v) for v in self._first(np.stack(vectors.to_numpy()))])

        return visits

    def second(self):
        @F.pandas_udf("array<int>")
        def visits(vectors: pd.Series, bounds: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            x, bound = np.stack(vectors.to_numpy()), bounds.to_numpy()
            step = max(1, DISTANCES_AT_ONCE // len(self.cells))
            return pd.Series([v for start in range(0, len(x), step) for v in self._second(x[start : start + step], bound[start : start + step])])

        return visits

    def _grouped(self, blocks: list[int]) -> list[int]:
        return sorted(set(self.group[blocks].tolist()))

    def _second(self, x: np.ndarray, bound: np.ndarray) -> list[list[int]]:
        d = _distances(x, self.pivots[self.cells])
        home = d.argmin(axis=1)
        away = d - self._reach()  # no point of the cell is nearer than this
        own, back = np.unique(home, return_inverse=True)
        apart = _distances(self.pivots[self.cells[own]], self.pivots[self.cells])[back]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - np.take_along_axis(d, home[:, None], axis=1) ** 2) / (2 * apart)
        away = np.maximum(away, np.where(apart > 0, plane, 0.0))
        slack = 1e-9 * (1 + np.abs(bound))
        done = self._first(x)
        wanted = []
        for row, seen in zip(away <= (bound + slack)[:, None], done, strict=True):
            seen = set(self.group[seen].tolist())
            places = [i for c in np.flatnonzero(row) for i in range(self.start[c], self.end[c])]
            wanted.append([i for i in self._grouped(places) if i not in seen])
        return wanted

    def _reach(self) -> np.ndarray:
        return np.maximum.reduceat(self.reach, self.start)
