"""Decision trees, random forests and extremely randomised trees, grown in two phases.

Equal rows are packed into one row with a count. Rows that are alike in all features can never be
parted, so they are written out together, as blocks of features with their labels, and a tree sees
a block as one row with sums of weights and labels: what a level costs grows with the distinct
features, not with the rows. While a node's rows do not
fit into a task, it is split over the cluster: each level is one pass over all rows for all trees, in
which tasks send histograms of quantile cells (or ranges and then drawn cuts) that are added up node
by node. Once the rows of a node fit, they travel once, keyed by tree and node, and the whole
subtree is grown where they meet, on exact thresholds. Inside a task all nodes of a level are split
together with sorted arrays, so that a node costs no call of its own.

A tree grows until its leaves are pure or alike in all features, unless settings stop it. All random
choices are hashes of the seed, the tree, the node's path and the row's values, so the forest depends
neither on the layout of the rows nor on retried tasks. A row's copies in a bootstrap sample are a
Poisson draw, as usual for data that is not counted out in one place.
"""

from __future__ import annotations

import json
import math
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

#: Bytes of rows from which a subtree is grown in one task, and of histograms in one pass.
TASK_BYTES = 64 << 20
QUANTILE_CELLS = 128
#: Distinct labels of a block of rows that are alike in all features.
BLOCK_LABELS = 512
#: A larger forest would not fit beside the rows it scores; bound its depth or its leaves instead.
MODEL_BYTES = 4 << 30
POISSON_TABLE = 64
#: Bytes of vectors that are scored at once.
SCORED_BYTES = 16 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class TreeRule:
    """How trees are grown. ``classes`` is 0 for regression; ``tried`` features are tried at a node;
    with ``random_cuts`` each has one threshold, uniform in the range of the node."""

    classes: int
    tried: int
    max_depth: int | None = None
    min_leaf: float = 1
    min_split: float = 2
    random_cuts: bool = False
    bootstrap: bool = False
    trees: int = 1
    seed: int = 42


# ---- random choices --------------------------------------------------------------------------------


def _mix(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values + _GOLDEN).astype(np.uint64)
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def _uniform(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1, without 1."""
    return (values >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def root_path(rule: TreeRule, tree: int) -> int:
    return int(_mix(np.array([rule.seed & 0xFFFFFFFF], np.uint64) << np.uint64(20) | np.uint64(tree))[0])


def _child_paths(paths: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.repeat(paths, 2) * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), len(paths)))


def _draws(paths: np.ndarray, width: int, salt: int) -> np.ndarray:
    """One number for each node and feature."""
    with np.errstate(over="ignore"):
        features = np.arange(width, dtype=np.uint64) * _GOLDEN + np.uint64(salt)
        return _uniform(_mix(paths[:, None] ^ _mix(features)[None, :]))


def tried_features(paths: np.ndarray, varies: np.ndarray, tried: int) -> np.ndarray:
    """Of each node ``tried`` of the features that vary in it, or all if there are fewer."""
    if tried >= varies.shape[1]:
        return varies
    keys = np.where(varies, _draws(paths, varies.shape[1], 1), 2.0)
    last = np.partition(keys, tried - 1, axis=1)[:, tried - 1 : tried]
    return varies & (keys <= last)


def sample_weights(hashes: np.ndarray, counts: np.ndarray, rule: TreeRule, tree: int) -> np.ndarray:
    """How often a tree sees each packed row: its count, or a Poisson draw around it."""
    if not rule.bootstrap:
        return counts.astype(np.float64)
    u = _uniform(_mix(hashes.view(np.uint64) ^ np.uint64(root_path(rule, tree))))
    weights = np.zeros(len(u))
    for count in np.unique(counts).tolist():
        at = counts == count
        if count <= POISSON_TABLE:
            k = np.arange(int(count + 12 * math.sqrt(count) + 20))
            logs = -count + k * math.log(count) - np.cumsum(np.log(np.maximum(k, 1)))
            weights[at] = np.searchsorted(np.cumsum(np.exp(logs)), u[at], side="right")
        else:
            draws = np.random.Generator(np.random.PCG64(root_path(rule, tree) ^ count))
            ordered = np.argsort(u[at])  # many equal rows: one stream, dealt out by their hashes
            drawn = np.empty(int(at.sum()))
            drawn[ordered] = draws.poisson(count, len(drawn))
            weights[at] = drawn
    return weights


# ---- subtrees in one task -----------------------------------------------------------------------


class Nodes:
    """Nodes of a tree in arrays: ``feature`` (-1: leaf), ``cut`` (of a leaf: its value or the row of
    its class shares in ``shares``), ``left`` (the right child is the next)."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, shares: np.ndarray):
        self.feature, self.cut, self.left, self.shares = feature, cut, left, shares

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.cut, self.left, self.shares))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            here = at[live]
            right = x[live, self.feature[here]] > self.cut[here]
            here = self.left[here] + right
            at[live] = here
            live = live[self.feature[here] >= 0]
        return at

    def squeezed(self) -> bytes:
        """The same without loss in fewer bytes: places of children as steps, cuts and leaves apart."""
        split = self.feature >= 0
        slots = self.cut[~split]
        if len(self.shares):  # of classes: leaves count their rows of shares
            slots = np.diff(slots, prepend=0.0)
        parts = (
            self.feature.astype("<i4"), np.diff(self.left[split], prepend=0).astype("<i4"), self.cut[split].astype("<f8"),
            slots.astype("<f8"), self.shares.astype("<f8").ravel(),
        )
        # the bytes of equal rank beside each other
        return zlib.compress(pickle.dumps([(a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in parts]), 1)

    @classmethod
    def unsqueezed(cls, data: bytes, classes: int) -> Nodes:
        parts = []
        for kind, held in pickle.loads(zlib.decompress(data)):
            size = np.dtype(kind).itemsize
            parts.append(np.frombuffer(held, np.uint8).reshape(size, -1).T.copy().view(kind).ravel())
        feature, steps, cuts, slots, shares = parts
        split = feature >= 0
        cut, left = np.zeros(len(feature)), np.zeros(len(feature), np.int32)
        left[split], cut[split] = np.cumsum(steps), cuts
        cut[~split] = np.cumsum(slots) if len(shares) else slots
        return cls(feature, cut, left, shares.reshape(-1, max(1, classes)))

    def pack(self) -> dict[str, bytes]:
        return {
            "feature": self.feature.astype("<i4").tobytes(), "cut": self.cut.astype("<f8").tobytes(),
            "left": self.left.astype("<i4").tobytes(), "shares": self.shares.astype("<f8").tobytes(),
        }

    @classmethod
    def unpack(cls, row, classes: int) -> Nodes:
        shares = np.frombuffer(row["shares"], "<f8").reshape(-1, max(1, classes))
        return cls(
            np.frombuffer(row["feature"], "<i4"), np.frombuffer(row["cut"], "<f8"),
            np.frombuffer(row["left"], "<i4"), shares,
        )


def _score(sums: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What a split maximises over both sides: the squared sums over the weight."""
    return (sums * sums).sum(axis=0) / weight


def _stable_parts(order: np.ndarray, node: np.ndarray, right: np.ndarray, lefts_before: np.ndarray, rights_before: np.ndarray,
                  starts: np.ndarray) -> np.ndarray:
    """``order``, grouped by node, grouped by child: the left ones of each node first, in their order."""
    side = right[order]
    rank = np.where(side, np.cumsum(side) - 1 - rights_before[node], np.cumsum(~side) - 1 - lefts_before[node])
    out = np.empty_like(order)
    out[starts[2 * node + side] + rank] = order
    return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, path: int, depth: int, rule: TreeRule) -> tuple[Nodes, np.ndarray]:
    """The subtree of some rows, and the gain of each feature in it."""
    return grow_blocks(x, _sums(y, w, rule, 0.0)[1:], y, y, 0.0, path, depth, rule)


def grow_blocks(x: np.ndarray, sums: np.ndarray, lowest: np.ndarray, highest: np.ndarray, centre: float, path: int, depth: int,
                rule: TreeRule) -> tuple[Nodes, np.ndarray]:
    """The same of blocks: ``sums`` of weights, and of weights by class or times the labels less
    ``centre``; ``lowest`` and ``highest`` label."""
    n, width = x.shape
    columns = np.ascontiguousarray(x.T)
    w, parts = sums[0], sums[1:]
    if not rule.classes:
        mean = parts[0].sum() / w.sum()
        parts, centre = parts - w * mean, centre + mean
    members = np.arange(n)
    orders = [] if rule.random_cuts else [np.argsort(c, kind="stable") for c in columns]
    sizes, paths = np.array([n]), np.array([path], np.uint64)
    out = {"feature": [], "cut": [], "left": [], "shares": []}
    gains, made, held = np.zeros(width), 1, 0
    while len(sizes):
        m = len(sizes)
        starts = np.cumsum(sizes) - sizes
        node = np.repeat(np.arange(m), sizes)
        weight = np.add.reduceat(w[members], starts)
        total = np.add.reduceat(parts[:, members], starts, axis=1)
        pure = np.minimum.reduceat(lowest[members], starts) == np.maximum.reduceat(highest[members], starts)
        open_ = ~pure & (weight >= rule.min_split) & (weight >= 2 * rule.min_leaf)
        if rule.max_depth is not None and depth >= rule.max_depth:
            open_[:] = False
        best = np.full(m, -np.inf)
        feature, cut = np.full(m, -1, np.int32), np.zeros(m)
        if open_.any():
            if rule.random_cuts:
                low = np.array([np.minimum.reduceat(c[members], starts) for c in columns])
                high = np.array([np.maximum.reduceat(c[members], starts) for c in columns])
            else:
                low = np.array([c[o[starts]] for c, o in zip(columns, orders, strict=True)])
                high = np.array([c[o[starts + sizes - 1]] for c, o in zip(columns, orders, strict=True)])
            tried = np.zeros((m, width), bool)
            tried[open_] = tried_features(paths[open_], (low < high).T[open_], rule.tried)
            base = _score(total, weight)
            drawn = _draws(paths, width, 2) if rule.random_cuts else None
            for f in range(width):
                if not tried[:, f].any():
                    continue
                if rule.random_cuts:
                    cuts = low[f] + drawn[:, f] * (high[f] - low[f])
                    cuts = np.where(cuts >= high[f], low[f], cuts)
                    found = _drawn_split(columns[f], members, node, w, parts, cuts, tried[:, f], sizes)
                else:
                    found = _best_split(columns[f], orders[f], node, w, parts, total, weight, tried[:, f], rule.min_leaf)
                at, cuts, left_weight, left = found
                right_weight = weight[at] - left_weight
                fits = (left_weight >= rule.min_leaf) & (right_weight >= rule.min_leaf) & (left_weight > 0) & (right_weight > 0)
                at, cuts, left_weight, right_weight, left = at[fits], cuts[fits], left_weight[fits], right_weight[fits], left[:, fits]
                gain = _score(left, left_weight) + _score(total[:, at] - left, right_weight) - base[at]
                better = gain > best[at]
                best[at[better]], feature[at[better]], cut[at[better]] = gain[better], f, cuts[better]
        split = feature >= 0
        np.add.at(gains, feature[split], np.maximum(best[split], 0))
        left_child = np.zeros(m, np.int32)
        left_child[split] = made + 2 * np.arange(int(split.sum()))
        if rule.classes:
            leaf = ~split
            cut[leaf] = held + np.arange(int(leaf.sum()))
            held += int(leaf.sum())
            out["shares"].append((total[:, leaf] / weight[leaf]).T)
        else:
            cut[~split] = total[0, ~split] / weight[~split] + centre
        for name, values in (("feature", feature), ("cut", cut), ("left", left_child)):
            out[name].append(values)
        made += 2 * int(split.sum())
        depth += 1
        # the rows of the nodes that were split, grouped by child
        keep = split[node]
        rank = np.cumsum(split) - 1
        right = np.zeros(n, bool)
        rows = members[keep]
        own = node[keep]
        right[rows] = columns[feature[own], rows] > cut[own]
        own = rank[own]
        child = 2 * own + right[rows]
        sizes = np.bincount(child, minlength=2 * int(split.sum()))
        paths = _child_paths(paths[split])
        begins = np.cumsum(sizes) - sizes
        lefts = np.cumsum(sizes[0::2]) - sizes[0::2]
        rights = np.cumsum(sizes[1::2]) - sizes[1::2]
        members = _stable_parts(rows, own, right, lefts, rights, begins)
        orders = [_stable_parts(o[keep], own, right, lefts, rights, begins) for o in orders]
    shares = np.concatenate(out["shares"]) if rule.classes else np.zeros((0, 1))
    feature, cut, left = (np.concatenate(out[k]) for k in ("feature", "cut", "left"))
    return Nodes(feature, cut, left, shares), gains


def _drawn_split(column, members, node, w, parts, cuts, tried, sizes):
    """Weights and sums left of the drawn cuts."""
    inside = tried[node]
    rows, own = members[inside], node[inside]
    left = column[rows] <= cuts[own]
    at = np.flatnonzero(tried)
    heads = np.cumsum(sizes[at]) - sizes[at]
    return (
        at, cuts[at], np.add.reduceat(np.where(left, w[rows], 0.0), heads),
        np.add.reduceat(np.where(left, parts[:, rows], 0.0), heads, axis=1),
    )


def _best_split(column, order, node, w, parts, total, weight, tried, min_leaf):
    """The best threshold between two neighbouring values of each node."""
    inside = tried[node]
    rows, own = order[inside], node[inside]
    values = column[rows]
    ends = np.flatnonzero((own[1:] == own[:-1]) & (values[1:] > values[:-1]))
    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    lengths = np.diff(np.r_[heads, len(own)])
    place = np.repeat(np.arange(len(heads)), lengths)[ends]

    def running(x):
        sums = np.cumsum(x, axis=-1)
        before = sums[..., heads] - x[..., heads]
        return sums[..., ends] - before[..., place]

    left_weight, left = running(w[rows]), running(parts[:, rows])
    nodes = own[ends]
    right_weight = weight[nodes] - left_weight
    fits = (left_weight >= min_leaf) & (right_weight >= min_leaf) & (left_weight > 0) & (right_weight > 0)
    ends, nodes, left_weight, right_weight, left = ends[fits], nodes[fits], left_weight[fits], right_weight[fits], left[:, fits]
    score = _score(left, left_weight) + _score(total[:, nodes] - left, right_weight)
    if not len(ends):
        return nodes, np.zeros(0), left_weight, left
    first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
    top = np.maximum.reduceat(score, first)
    hits = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[first, len(nodes)])))
    hits = hits[np.r_[True, nodes[hits][1:] != nodes[hits][:-1]]]
    low, high = values[ends[hits]], values[ends[hits] + 1]
    middle = low + (high - low) / 2
    return nodes[hits], np.where(middle >= high, low, middle), left_weight[hits], left[:, hits]


# ---- growth over the cluster --------------------------------------------------------------------


@dataclass
class _Top:
    """The nodes of one tree that are split over the cluster, grown on the driver."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    paths: list[int]
    depths: list[int]
    values: dict[int, np.ndarray]  # of leaves: class shares or mean
    open: list[int]  # too large for a task
    local: list[int]  # to be grown in a task

    @classmethod
    def of(cls, path: int, large: bool) -> _Top:
        return cls([-1], [0.0], [0], [path], [0], {}, [0] if large else [], [] if large else [0])

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature, np.int32), np.array(self.cut), np.array(self.left, np.int32), np.zeros((0, 1)))

    def split(self, node: int, feature: int, cut: float, large: tuple[bool, bool]) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        paths = _child_paths(np.array([self.paths[node]], np.uint64)).tolist()
        for path, big in zip(paths, large, strict=True):
            (self.open if big else self.local).append(len(self.feature))
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(0)
            self.paths.append(path)
            self.depths.append(self.depths[node] + 1)


class _Batch:
    """Blocks of rows that are alike in all features, with the labels, counts and hashes of each."""

    def __init__(self, batch: pa.RecordBatch):
        labels = batch.column("rows")
        fields = labels.flatten()
        self.starts = np.cumsum(np.r_[0, pa.compute.list_value_length(labels).to_numpy(zero_copy_only=False)[:-1]])
        self.h, self.y, self.n = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        self.x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        self.g = batch.column("g").to_numpy()

    def summed(self, rule: TreeRule, tree: int, centre: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a tree sees of each block: one, its sums, and its lowest and highest label."""
        w = sample_weights(self.h, self.n, rule, tree)
        sums = np.add.reduceat(_sums(self.y, w, rule, centre), self.starts, axis=1)
        sums[0] = 1.0
        lowest = np.minimum.reduceat(np.where(w > 0, self.y, np.inf), self.starts)
        highest = np.maximum.reduceat(np.where(w > 0, self.y, -np.inf), self.starts)
        return sums, lowest, highest


def _routed(rows: DataFrame, tops: list[_Top], rule: TreeRule, centre: float, wanted: list[list[int]], visit, schema: str) -> DataFrame:
    """Run ``visit(tree, wanted[tree], place of the node there, x, sums, lowest, highest, g)`` over the
    blocks of the wanted nodes, batch by batch; it returns an object whose ``rows()`` are given out
    at the task's end, or rows at once."""
    routes = {t: (top.nodes(), wanted[t]) for t, top in enumerate(tops) if wanted[t]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = visit()
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, seen = _Batch(batch), None
            for tree, (nodes, some) in routes.items():
                if seen is None or rule.bootstrap:
                    seen = blocks.summed(rule, tree, centre)
                sums, lowest, highest = seen
                place = np.full(len(nodes.feature), -1)
                place[some] = np.arange(len(some))
                at = place[nodes.leaves(blocks.x)]
                use = np.flatnonzero((sums[1] > 0) & (at >= 0))
                if len(use):
                    yield from gather.add(tree, some, at[use], blocks.x[use], sums[:, use], lowest[use], highest[use], blocks.g[use])
        yield from gather.rows()

    return rows.mapInArrow(run, schema)


def _record(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_BLOB = "tree int, node int, data binary"
_BLOB_NAMES, _BLOB_TYPES = ["tree", "node", "data"], [pa.int32(), pa.int32(), pa.binary()]


class _Adder:
    """Adds arrays by tree and node; ``measure`` gives the array of the blocks of all nodes."""

    def __init__(self, measure):
        self.measure, self.held = measure, {}

    def add(self, tree, some, at, x, sums, lowest, highest, g):
        found = self.measure(tree, some, at, x, sums, lowest, highest)
        if tree in self.held:
            found = self.combine(self.held[tree][1], found)
        self.held[tree] = some, found
        return ()

    @staticmethod
    def combine(a, b):
        return a + b

    def rows(self):
        for tree, (some, found) in self.held.items():
            yield _record([(tree, node, found[i].tobytes()) for i, node in enumerate(some)], _BLOB_NAMES, _BLOB_TYPES)


class _RangeAdder(_Adder):
    """Elementwise minimum."""

    combine = staticmethod(np.minimum)


class _Sender:
    """Sends what a tree sees of each node as tables of numbers: hash of the features, lowest and
    highest label, sums, features."""

    def add(self, tree, some, at, x, sums, lowest, highest, g):
        order = np.argsort(at, kind="stable")
        block = np.column_stack([g[order].view(np.float64), lowest[order], highest[order], sums[1:, order].T, x[order]])
        edges = np.searchsorted(at[order], np.arange(len(some) + 1))
        rows = [(tree, some[i], block[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        yield _record(rows, _BLOB_NAMES, _BLOB_TYPES)

    def rows(self):
        return iter(())


def _sums(y: np.ndarray, w: np.ndarray, rule: TreeRule, centre: float) -> np.ndarray:
    """For each row: one, its weight, and its weight by class or times its label."""
    parts = [w * (y == c) for c in range(rule.classes)] if rule.classes else [w * (y - centre)]
    return np.array([np.ones(len(y)), w, *parts])


def _cell_sums(cells: list[np.ndarray], width: int):
    n_cells = max(len(c) for c in cells) + 1

    def measure(tree, some, at, x, sums, lowest, highest):
        out = np.zeros((len(some), width, n_cells, len(sums)))
        for f in range(width):
            key = at * n_cells + np.searchsorted(cells[f], x[:, f], side="left")
            for s, values in enumerate(sums):
                out[:, f, :, s] = np.bincount(key, values, len(some) * n_cells).reshape(len(some), n_cells)
        return out

    return measure, n_cells


def _node_ranges(width: int):
    """Lowest and (negative) highest label and features of each node."""

    def measure(tree, some, at, x, sums, lowest, highest):
        out = np.full((len(some), 2, width + 1), np.inf)
        np.minimum.at(out[:, 0], at, np.column_stack([lowest, x]))
        np.minimum.at(out[:, 1], at, -np.column_stack([highest, x]))
        return out

    return measure


def _cut_sums(cuts: dict[int, np.ndarray], width: int):
    """Sums of each node, and left of the cut of each feature (without a cut: nothing)."""

    def measure(tree, some, at, x, sums, lowest, highest):
        out = np.zeros((len(some), width + 1, len(sums)))
        for f in range(width):
            left = x[:, f] <= cuts[tree][at, f]
            for s, values in enumerate(sums):
                out[:, f, s] = np.bincount(at[left], values[left], len(some))
        for s, values in enumerate(sums):
            out[:, width, s] = np.bincount(at, values, len(some))
        return out

    return measure


def _added(blobs: DataFrame, lowest: bool = False) -> DataFrame:
    """One array for each tree and node."""

    def add(table: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(b.as_py()) for b in table["data"]]
        total = arrays[0].copy()
        for a in arrays[1:]:
            total = np.minimum(total, a) if lowest else total + a
        return pa.table({"tree": table["tree"][:1], "node": table["node"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    return blobs.groupBy("tree", "node").applyInArrow(add, _BLOB)


def _choose(options: list[tuple[np.ndarray, np.ndarray, np.ndarray]], total: np.ndarray, rule: TreeRule):
    """The best of the splits of each feature: (left sums, cuts) with sums (rows, weight, parts)."""
    best = None
    base = (total[2:] ** 2).sum() / total[1]
    for f, (left, cuts) in options:
        right = total - left
        fits = (np.minimum(left[:, 1], right[:, 1]) >= rule.min_leaf) & (np.minimum(left[:, 0], right[:, 0]) > 0)
        if not fits.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[:, 2:] ** 2).sum(axis=1) / left[:, 1] + (right[:, 2:] ** 2).sum(axis=1) / right[:, 1] - base
        gain = np.where(fits, gain, -np.inf)
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0]:
            best = float(gain[k]), f, float(cuts[k]), float(left[k, 0]), float(right[k, 0])
    return best


def _stops(total: np.ndarray, low: float, high: float, depth: int, rule: TreeRule) -> bool:
    deep = rule.max_depth is not None and depth >= rule.max_depth
    return deep or low == high or total[1] < rule.min_split or total[1] < 2 * rule.min_leaf


def _sent_bytes(width: int, rule: TreeRule) -> int:
    """Of a block, as it travels to where a subtree is grown."""
    return 8 * (width + 4 + max(1, rule.classes))


def _grow_tops(rows: DataFrame, n_rows: int, width: int, rule: TreeRule, centre: float, task_bytes: int):
    """Split the nodes whose rows do not fit into a task."""
    most = max(1, task_bytes // _sent_bytes(width, rule))
    tops = [_Top.of(root_path(rule, t), n_rows > most) for t in range(rule.trees)]
    gains = np.zeros(width)
    cells = [] if rule.random_cuts or not tops[0].open else quantile_cells(rows, width)
    n_cells = 1 if rule.random_cuts else max((len(c) for c in cells), default=0) + 1
    cost = 8 * width * n_cells * (2 + max(1, rule.classes))
    while any(top.open for top in tops):
        todo = [(t, node) for t, top in enumerate(tops) for node in top.open][: max(1, task_bytes // cost)]
        wanted = [[node for u, node in todo if u == t] for t in range(rule.trees)]
        found = _pass(rows, tops, wanted, rule, centre, width, cells)
        for t, node in todo:
            top = tops[t]
            top.open.remove(node)
            total, best = found[t, node]
            if best is None:
                top.values[node] = total[2:] / total[1] + (0 if rule.classes else centre)
                continue
            gain, f, cut, n_left, n_right = best
            gains[f] += max(gain, 0.0)
            top.split(node, f, cut, (n_left > most, n_right > most))
    return tops, gains


def _pass(rows, tops, wanted, rule, centre, width, cells):
    """For each wanted node its sums and the best split, if it has one."""
    found = {}
    ranges_of = _RangeAdder(_node_ranges(width))
    ranges = {
        (r["tree"], r["node"]): np.frombuffer(r["data"]).reshape(2, width + 1)
        for r in _added(_routed(rows, tops, rule, centre, wanted, lambda: ranges_of, _BLOB), lowest=True).collect()
    }
    tried = {}
    for key, (low, high) in ranges.items():
        path = np.array([tops[key[0]].paths[key[1]]], np.uint64)
        tried[key] = tried_features(path, (low[1:] < -high[1:])[None, :], rule.tried)[0]
    stats = 2 + max(1, rule.classes)
    if rule.random_cuts:
        cuts = {}
        for t, nodes in enumerate(wanted):
            if nodes:
                low, high = (np.array([s * ranges[t, v][k, 1:] for v in nodes]) for k, s in ((0, 1), (1, -1)))
                paths = np.array([tops[t].paths[v] for v in nodes], np.uint64)
                drawn = low + _draws(paths, width, 2) * (high - low)
                cuts[t] = np.where(drawn >= high, low, drawn)
        adder = _Adder(_cut_sums(cuts, width))
        for r in _added(_routed(rows, tops, rule, centre, wanted, lambda: adder, _BLOB)).collect():
            key = r["tree"], r["node"]
            sums = np.frombuffer(r["data"]).reshape(width + 1, stats)
            own = cuts[key[0]][wanted[key[0]].index(key[1])]
            options = [(f, (sums[f : f + 1], own[f : f + 1])) for f in np.flatnonzero(tried[key])]
            found[key] = sums[width], options
    else:
        measure, n_cells = _cell_sums(cells, width)
        adder = _Adder(measure)
        for r in _added(_routed(rows, tops, rule, centre, wanted, lambda: adder, _BLOB)).collect():
            key = r["tree"], r["node"]
            sums = np.frombuffer(r["data"]).reshape(width, n_cells, stats)
            options = [
                (f, (np.cumsum(sums[f], axis=0)[: len(cells[f])], cells[f])) for f in np.flatnonzero(tried[key]) if len(cells[f])
            ]
            found[key] = sums[0].sum(axis=0), options
    out = {}
    for key, (total, options) in found.items():
        low, high = ranges[key][:, 0]
        stop = _stops(total, low, -high, tops[key[0]].depths[key[1]], rule)
        best = None if stop else _choose(options, total, rule)
        if best is None and not stop and not rule.random_cuts and tried[key].any():
            spans = [(int(f), ranges[key][0, f + 1], -ranges[key][1, f + 1]) for f in np.flatnonzero(tried[key])]
            if not any(((cells[f] >= a) & (cells[f] < b)).any() for f, a, b in spans):
                # all rows lie in one cell of each feature tried: cut such a cell in the middle of their range
                f, a, b = spans[0]
                middle = a + (b - a) / 2
                cells[f] = np.unique(np.r_[cells[f], middle if middle < b else a])
                return _pass(rows, tops, wanted, rule, centre, width, cells)
        out[key] = total, best
    return out


def quantile_cells(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Of every feature the borders of its quantile cells, as cuts: at most ``QUANTILE_CELLS``."""
    steps = [k / QUANTILE_CELLS for k in range(1, QUANTILE_CELLS)]
    values = rows.select(F.posexplode("x").alias("i", "v"))
    found = values.groupBy("i").agg(F.percentile_approx("v", steps).alias("q")).collect()
    by_feature = {r["i"]: r["q"] for r in found}
    return [np.unique(by_feature.get(f, [])) for f in range(width)]


def _blocks(rows: DataFrame) -> DataFrame:
    """``x, g, rows`` of packed rows: their features, a hash of these, and ``h, y, n`` of the labels. What
    is alike in all features is cut by hash, so that no block has many more than ``BLOCK_LABELS``."""
    many = rows.groupBy("x").agg(F.count(F.lit(1)).alias("labels")).filter(F.col("labels") > BLOCK_LABELS)
    parts = many.select("x", F.ceil(F.col("labels") / BLOCK_LABELS).alias("parts"))
    cut = rows.join(parts, "x", "left").withColumn("part", F.coalesce(F.pmod("h", "parts"), F.lit(0)))
    labels = F.array_sort(F.collect_list(F.struct("h", "y", "n")))
    return cut_lineage(cut.groupBy("x", "part").agg(labels.alias("rows")).select("x", F.xxhash64("x").alias("g"), "rows"))


_SUBTREE = "tree int, node int, data binary, size bigint, gains array<double>"


def _grow_locals(rows: DataFrame, tops: list[_Top], width: int, rule: TreeRule, centre: float) -> DataFrame:
    """The subtrees of the nodes whose rows fit into a task."""
    wanted = [top.local for top in tops]
    places = {(t, v): (top.paths[v], top.depths[v]) for t, top in enumerate(tops) for v in top.local}
    sent = _routed(rows, tops, rule, centre, wanted, _Sender, _BLOB)
    held = _sent_bytes(width, rule) // 8
    start = held - width

    def subtree(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        block = np.concatenate([np.frombuffer(b.as_buffer()).reshape(-1, held) for b in table["data"]])
        # the same order whatever the layout; blocks that are alike in all features become one
        block = block[np.lexsort((block[:, 4], block[:, 3], block[:, 1], block[:, 0].copy().view(np.int64)))]
        heads = np.flatnonzero(np.r_[True, (block[1:, start:] != block[:-1, start:]).any(axis=1)])
        x, sums = np.ascontiguousarray(block[heads, start:]), np.add.reduceat(block[:, 3:start], heads).T.copy()
        lowest, highest = np.minimum.reduceat(block[:, 1], heads), np.maximum.reduceat(block[:, 2], heads)
        del block
        nodes, gains = grow_blocks(x, sums, lowest, highest, centre, *places[tree, node], rule)
        row = {"tree": tree, "node": node, "data": nodes.squeezed(), "size": nodes.nbytes, "gains": gains.tolist()}
        types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.float64())]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types, strict=True)})

    return sent.groupBy("tree", "node").applyInArrow(subtree, _SUBTREE)


def _assembled(top: _Top, subtrees: dict[int, Nodes], classes: int) -> Nodes:
    """One tree from its top and the subtrees below it."""
    feature, cut, left = [np.array(top.feature, np.int32)], [np.array(top.cut, float)], [np.array(top.left, np.int32)]
    shares, held, made = [], 0, len(top.feature)
    for node, value in top.values.items():
        cut[0][node] = held if classes else value[0]
        if classes:
            shares.append(value[None, :])
            held += 1
    for node, sub in subtrees.items():
        # the subtree's root takes the place of the node; the others follow at the end
        moved = np.where(sub.feature >= 0, sub.left + made - 1, 0).astype(np.int32)
        cuts = np.where(sub.feature >= 0, sub.cut, sub.cut + held) if classes else sub.cut
        feature[0][node], cut[0][node], left[0][node] = sub.feature[0], cuts[0], moved[0]
        feature.append(sub.feature[1:])
        cut.append(cuts[1:])
        left.append(moved[1:])
        shares.append(sub.shares)
        held += len(sub.shares)
        made += len(sub.feature) - 1
    joined = np.concatenate(shares) if shares else np.zeros((0, max(1, classes)))
    return Nodes(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), joined)


def _scores(squeezed: list[bytes], classes: int, x: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), max(1, classes)))
    for data in squeezed:
        tree = Nodes.unsqueezed(data, classes)
        value = tree.cut[tree.leaves(x)]
        total += tree.shares[value.astype(np.int64)] if classes else value[:, None]
    return total / len(squeezed)


def _scored(held: list[pd.Series], squeezed: list[bytes], classes: int) -> Iterator[pd.Series]:
    """The scores of some batches of vectors, batch by batch."""
    full = [v for v in held if len(v)]
    scores = _scores(squeezed, classes, np.concatenate([np.stack(v.to_numpy()) for v in full])) if full else None
    start = 0
    for vectors in held:
        yield pd.Series(list(scores[start : start + len(vectors)]) if len(vectors) else [], dtype=object)
        start += len(vectors)


class Forest:
    """Trees that score rows: ``transform`` adds ``prediction`` and, for classes, ``probability``.

    The trees are kept without loss in few bytes and broadcast for scoring, where one at a time is
    opened for many rows; fitting refuses a forest whose arrays (16 bytes a node, and shares a leaf)
    have more than ``MODEL_BYTES`` and names the settings that make it smaller.
    """

    def __init__(self, trees: Iterable[Nodes], rule: TreeRule, width: int, gains: np.ndarray):
        self.squeezed = [nodes.squeezed() for nodes in trees]
        self.rule, self.width, self.gains = rule, width, gains
        self._shared = None

    @classmethod
    def fit(cls, df: DataFrame, rule: TreeRule, task_bytes: int = TASK_BYTES) -> Forest:
        """Fit on ``features`` and ``label`` (for classes: their positions)."""
        x = vector_to_array("features").alias("x")
        packed = df.select(x, F.col("label").cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        rows = cut_lineage(packed.select("x", "y", "n", F.xxhash64("x", "y").alias("h")))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("centre")).first()
        if not size["n"]:
            raise ValueError("A forest needs rows.")
        width, centre = size["width"], size["centre"]
        blocks = _blocks(rows)
        tops, gains = _grow_tops(blocks, blocks.count(), width, rule, centre, task_bytes)
        grown = cut_lineage(_grow_locals(blocks, tops, width, rule, centre))
        bytes_ = grown.agg(F.sum("size")).first()[0] or 0
        if bytes_ > MODEL_BYTES:
            raise ValueError(f"The forest has {bytes_} bytes: max_depth, min_samples_leaf or n_estimators make it smaller")
        subtrees: list[dict[int, bytes]] = [{} for _ in tops]
        for row in grown.toLocalIterator():
            subtrees[row["tree"]][row["node"]] = bytes(row["data"])
            gains = gains + np.array(row["gains"])
        trees = (
            _assembled(top, {node: Nodes.unsqueezed(data, rule.classes) for node, data in sorted(subs.items())}, rule.classes)
            for top, subs in zip(tops, subtrees, strict=True)
        )
        return cls(trees, rule, width, gains)

    @property
    def trees(self) -> list[Nodes]:
        return [Nodes.unsqueezed(data, self.rule.classes) for data in self.squeezed]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name that Spark's models use
        total = self.gains.sum()
        return DenseVector(self.gains / total if total > 0 else self.gains)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees of class shares, or of predictions."""
        return _scores(self.squeezed, self.rule.classes, x)

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self.squeezed)
        shared, classes, most = self._shared, self.rule.classes, max(1, SCORED_BYTES // (8 * self.width))

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, rows = [], 0
            for vectors in batches:
                held.append(vectors)
                rows += len(vectors)
                if rows >= most:
                    yield from _scored(held, shared.value, classes)
                    held, rows = [], 0
            yield from _scored(held, shared.value, classes)

        scores = score(vector_to_array("features"))
        if not self.rule.classes:
            return df.withColumn("prediction", F.get(scores, F.lit(0)))
        found = df.withColumn("probability", array_to_vector(scores))
        share = vector_to_array("probability")
        return found.withColumn("prediction", (F.array_position(share, F.array_max(share)) - 1).cast("double"))

    def save(self, path: str) -> None:
        """Write one row for each tree, and the settings."""
        spark = SparkSession.active()
        about = json.dumps({"rule": asdict(self.rule), "width": self.width, "gains": self.gains.tolist()})
        rows = [(t, about, *nodes.pack().values()) for t, nodes in enumerate(self.trees)]
        schema = "tree int, about string, feature binary, cut binary, left binary, shares binary"
        spark.createDataFrame(rows, schema).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        rows = sorted(spark.read.parquet(path).toLocalIterator(), key=lambda r: r["tree"])
        about = json.loads(rows[0]["about"])
        rule = TreeRule(**about["rule"])
        return cls([Nodes.unpack(r, rule.classes) for r in rows], rule, about["width"], np.array(about["gains"]))
