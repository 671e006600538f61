"""Splits and folds by rank selection: exact sizes, any keys, and no exchange of whole rows."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import split as S
from tablewright.operators.ordering import hash_numbered
from tablewright.functions.scalars import quoted


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 10 < 6, "many").when(F.col("id") % 10 < 9, "some").when(F.col("id") % 20 == 9, F.lit(None)).otherwise("few")
    return spark.range(997).select(F.when(F.col("id") > 0, F.col("id")).alias("k 1"), label.alias("label"), F.repeat(F.lit("wide"), 50).alias("wide"))


@pytest.mark.parametrize("label", [None, "label"])
def test_split_equals_numbering(rows, label):
    for share in (0.2, 0.01, 0.5):
        found = S.assign_split(rows, test_size=share, label=label, key=["k 1"])
        by = [quoted(label)] if label else None
        numbered = hash_numbered(rows, by=by, key=["k 1"])
        first = {r["k 1"] for r in found.filter("is_test").collect()}
        assert found.columns == [*rows.columns, "is_test"] and len(first) == -(-997 * int(share * 100) // 100)
        sizes = {r["label"]: r["n"] for r in found.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
        if label:
            for r in numbered.collect():
                assert (r["k 1"] in first) == (r["_number"] < sizes.get(r["label"], 0))
        else:
            assert first == {r["k 1"] for r in numbered.filter(F.col("_number") < len(first)).collect()}


def test_quotas_by_largest_remainder(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5 + [("c",)] * 4 + [(None,)], "label string")
    got = {r["label"]: (r["total"], r["quota"]) for r in S.test_quotas(df, "label", 0.3).collect()}
    # five of fifteen: 1 + 1 + 1 + 0 whole, then the largest remainders 10, 10, 5, 5
    assert got == {"a": (5, 2), "b": (5, 2), "c": (4, 1), None: (1, 0)}


@pytest.mark.parametrize("folds", [2, 3, 7])
def test_folds_are_stretches(rows, folds):
    found = {r["k 1"]: r["fold"] for r in S.assign_folds(rows, folds=folds, key=["k 1"]).collect()}
    for r in hash_numbered(rows, key=["k 1"]).collect():
        assert found[r["k 1"]] == r["_number"] * folds // r["_total"]


def test_more_folds_than_rows(spark):
    few = spark.range(2).select(F.col("id").alias("k"))
    assert sorted(r["fold"] for r in S.assign_folds(few, folds=5, key=["k"]).collect()) == [0, 2]


def test_whole_rows_stay_where_they_are(rows, spark, tmp_path):
    rows.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    for marked in (S.assign_split(stored, label="label", key=["k 1"]), S.assign_split(stored, key=["k 1"]), S.assign_folds(stored, key=["k 1"])):
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, label string")
    assert S.assign_split(empty, label="label", key=["k"]).count() == 0 == S.assign_split(empty, key=["k"]).count()
    assert S.assign_folds(empty, key=["k"]).count() == 0
