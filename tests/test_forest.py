"""Trees: subtrees in one task against a plain recursion, and growth over the cluster."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tablewright.ml import algorithms as A
from tablewright.ml import forest
from tablewright.ml.forest import Forest, TreeRule, grow


def frame_of(spark, x, y):
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, label double")
    return df.select(array_to_vector("x").alias("features"), "label")


def impurity(y, w, classes):
    if classes:
        shares = np.array([w[y == c].sum() for c in range(classes)])
        return w.sum() - (shares**2).sum() / w.sum()
    return (w * (y - np.average(y, weights=w)) ** 2).sum()


def plain_tree(x, y, w, rule, at=None, depth=0):
    """Predictions of a tree that tries every cut of every feature at every node."""
    at = np.arange(len(x)) if at is None else at
    here, best = impurity(y[at], w[at], rule.classes), None
    if len(np.unique(y[at])) > 1 and (rule.max_depth is None or depth < rule.max_depth) and w[at].sum() >= rule.min_split:
        for f in range(x.shape[1]):
            values = np.unique(x[at, f])
            for a, b in zip(values[:-1], values[1:], strict=True):
                left, right = at[x[at, f] <= a], at[x[at, f] >= b]
                if min(w[left].sum(), w[right].sum()) >= rule.min_leaf:
                    gain = here - impurity(y[left], w[left], rule.classes) - impurity(y[right], w[right], rule.classes)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, left, right
    if best is None:
        value = [w[at][y[at] == c].sum() / w[at].sum() for c in range(rule.classes)] or [np.average(y[at], weights=w[at])]
        return dict.fromkeys(at.tolist(), value)
    return plain_tree(x, y, w, rule, best[1], depth + 1) | plain_tree(x, y, w, rule, best[2], depth + 1)


def test_subtrees_equal_a_plain_recursion():
    rng = np.random.default_rng(1)
    for _ in range(120):
        n, classes = int(rng.integers(1, 40)), int(rng.choice([0, 2, 3]))
        x = rng.normal(size=(n, int(rng.integers(1, 4)))).round(int(rng.integers(0, 3)))
        y = rng.integers(0, classes, n).astype(float) if classes else rng.normal(size=n)
        w = rng.integers(1, 4, n).astype(float)
        rule = TreeRule(classes, x.shape[1], int(rng.integers(1, 6)), int(rng.integers(1, 4)), int(rng.integers(2, 6)))
        nodes, _ = grow(x, y, w, 7, 0, rule)
        value = nodes.cut[nodes.leaves(x)]
        found = nodes.shares[value.astype(int)] if classes else value[:, None]
        expected = plain_tree(x, y, w, rule)
        assert np.allclose(found, [expected[i] for i in range(n)])


@pytest.mark.parametrize("random_cuts", [False, True])
@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("task_bytes", [64 << 20, 4000])
def test_full_trees_give_the_mean_of_equal_rows(spark, random_cuts, classes, task_bytes):
    """Leaves are pure or alike in all features, whether nodes were split over the cluster or in tasks."""
    rng = np.random.default_rng(2)
    x = np.column_stack([np.exp(rng.normal(0, 6, 600)).round(3), rng.integers(0, 3, 600), np.full(600, 5.0)])
    x[:200] = x[200:400]
    y = rng.integers(0, 3, 600).astype(float) if classes else rng.normal(100, 5, 600)
    rule = TreeRule(classes, 1 if random_cuts else 3, random_cuts=random_cuts, trees=3)
    frame = frame_of(spark, x, y)
    model = Forest.fit(frame, rule, task_bytes)
    groups = {}
    for row, label in zip(map(tuple, x), y, strict=True):
        groups.setdefault(row, []).append(label)
    for r in model.transform(frame).collect():
        labels = groups[tuple(r.features.toArray())]
        if classes:
            assert np.allclose(r.probability.toArray(), np.bincount(np.array(labels, int), minlength=3) / len(labels))
        else:
            assert np.isclose(r.prediction, np.mean(labels))
    again = Forest.fit(frame.repartition(7), rule, task_bytes)
    assert all(np.array_equal(a.feature, b.feature) and np.allclose(a.cut, b.cut) for a, b in zip(model.trees, again.trees, strict=True))
    assert model.featureImportances.toArray()[2] == 0 and np.isclose(model.featureImportances.toArray().sum(), 1)


def test_settings_bind_in_both_phases(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 4)), rng.normal(size=500)
    frame = frame_of(spark, x, y)
    for task_bytes in (64 << 20, 4000):
        model = Forest.fit(frame, TreeRule(0, 4, max_depth=3), task_bytes)
        assert len(model.trees[0].feature) == 15
        for random_cuts in (False, True):
            model = Forest.fit(frame, TreeRule(0, 4, min_leaf=20, min_split=90, random_cuts=random_cuts), task_bytes)
            nodes = model.trees[0]
            held = np.bincount(nodes.leaves(x), minlength=len(nodes.feature))
            assert held[held > 0].min() >= 20
            for node in range(len(nodes.feature) - 1, -1, -1):  # rows of inner nodes, from below
                if nodes.feature[node] >= 0:
                    held[node] = held[nodes.left[node]] + held[nodes.left[node] + 1]
                    assert held[node] >= 90
    space = A.get_algorithm("random_forest").spaces["regression"], A.get_algorithm("decision_tree").spaces["regression"]
    assert all("min_samples_split" in s for s in space)


def test_cuts_are_drawn_in_the_range_of_each_node(spark):
    """Two clusters of values far from each other: below the first split, cuts lie inside each."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.uniform(0, 1, 200), rng.uniform(1e6, 1e6 + 1, 200)][:, None]
    for task_bytes in (64 << 20, 2000):
        model = Forest.fit(frame_of(spark, x, rng.normal(size=400)), TreeRule(0, 1, random_cuts=True, trees=4), task_bytes)
        roots = [t.cut[0] for t in model.trees]
        assert len(set(roots)) == 4
        for t in model.trees:
            inner = t.cut[t.feature >= 0][1:]
            assert (inner <= 1).sum() > 100 and (inner >= 1e6).sum() > 100


def test_bootstrap_counts():
    rng = np.random.default_rng(5)
    hashes = rng.integers(-(2**63), 2**63 - 1, 20_000)
    rule = TreeRule(0, 1, bootstrap=True, trees=2)
    for count in (1, 5, 200):
        counts = np.full(len(hashes), count)
        w = forest.sample_weights(hashes, counts, rule, 0)
        assert abs(w.mean() - count) < 0.05 * count and abs(w.var() - count) < 0.1 * count
        assert np.array_equal(w, forest.sample_weights(hashes, counts, rule, 0))
        assert not np.array_equal(w, forest.sample_weights(hashes, counts, rule, 1))


def test_too_large_a_forest_is_refused(spark, monkeypatch):
    monkeypatch.setattr(forest, "MODEL_BYTES", 100)
    rng = np.random.default_rng(6)
    with pytest.raises(ValueError, match="max_depth"):
        Forest.fit(frame_of(spark, rng.normal(size=(50, 2)), rng.normal(size=50)), TreeRule(0, 2))
    with pytest.raises(ValueError):
        Forest.fit(frame_of(spark, rng.normal(size=(1, 2)), [1.0]).limit(0), TreeRule(0, 2))


@pytest.mark.parametrize("classes", [0, 2])
def test_rows_alike_in_all_features_are_seen_as_blocks(spark, monkeypatch, classes):
    """What trees are grown from follows the distinct features, not the labels; a hot one is cut."""
    monkeypatch.setattr(forest, "BLOCK_LABELS", 64)
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 3, 2000), np.full(2000, 1.0)]).astype(float)
    x[:5, 1] = np.arange(5)
    y = rng.integers(0, 2, 2000).astype(float) if classes else rng.normal(50, 3, 2000)
    seen, tops = [], forest._grow_tops
    monkeypatch.setattr(forest, "_grow_tops", lambda rows, n, *rest: seen.append(n) or tops(rows, n, *rest))
    model = Forest.fit(frame_of(spark, x, y), TreeRule(classes, 2, trees=2))
    assert len(np.unique(x, axis=0)) <= seen[0] <= 100
    for row in np.unique(x, axis=0):
        labels = y[(x == row).all(axis=1)]
        assert np.isclose(model.scores(row[None])[0][-1], labels.mean())


def test_models_travel_in_few_bytes_without_loss(spark, monkeypatch):
    monkeypatch.setattr(forest, "SCORED_BYTES", 1000)
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(3000, 3)).round(2), rng.integers(0, 2, 3000).astype(float)
    nodes, _ = grow(x, y, np.ones(3000), 7, 0, TreeRule(2, 3))
    data = nodes.squeezed()
    again = forest.Nodes.unsqueezed(data, 2)
    assert all(np.array_equal(getattr(nodes, k), getattr(again, k)) for k in ("feature", "cut", "left", "shares"))
    assert len(data) < nodes.nbytes / 3
    frame = frame_of(spark, x, y).coalesce(2)
    model = Forest.fit(frame, TreeRule(2, 3, trees=2), 20_000)
    scored = {tuple(r.features.toArray()): r.probability.toArray() for r in model.transform(frame).collect()}
    assert np.allclose(model.scores(x), [scored[tuple(row)] for row in x])
