from pyspark.sql import functions as F

from tablewright.operators import ordering as O
from tablewright.operators.split import assign_folds, assign_split


def test_copies_of_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(O, "COPIES_PER_TASK_ROW", 7)
    df = spark.range(100).select(F.when(F.col("id") < 40, 0).otherwise(F.col("id")).alias("v"))
    rows = O.number_copies(df).collect()
    assert len(rows) == 100
    assert sorted(r["_copy"] for r in rows if r["v"] == 0) == list(range(40))


def test_hash_numbers_are_a_permutation(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    rows = O.hash_numbered(df, by=[F.col("g")], key=["id"]).collect()
    for g in range(3):
        mine = [r for r in rows if r["g"] == g]
        assert sorted(r["_number"] for r in mine) == list(range(len(mine)))
        assert {r["_total"] for r in mine} == {len(mine)}


def test_running_totals_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_RANGE_CELL", 50)
    values = [(float(i * i % 1009), i % 5, i % 2) for i in range(1009)]
    df = spark.createDataFrame(values, "x double, n bigint, g int").groupBy("g", "x").agg(
        F.sum("n").alias("n")
    )
    for ascending in (True, False):
        rows = O.running_totals(df, order="x", sums=["n"], by=["g"], ascending=ascending).collect()
        for g in (0, 1):
            total = 0
            for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["x"] if ascending else -r["x"]):
                total += r["n"]
                assert r["cum_n"] == total


def test_split_of_copies_is_exact(spark):
    """A third of the rows are equal; the split is still exact and does not depend on layout."""
    df = spark.range(300).select(
        F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("v"), (F.col("id") % 2).alias("c")
    )
    seen = set()
    for parts in (1, 6):
        marked = assign_split(df.repartition(parts), label="c", test_size=0.2)
        tests = marked.filter("is_test")
        assert marked.count() == 300 and tests.count() == 60
        assert [r["count"] for r in tests.groupBy("c").count().collect()] == [30, 30]
        seen.add(tuple(sorted((r["v"], r["c"]) for r in tests.collect())))
    assert len(seen) == 1


def test_folds_are_even(spark):
    df = spark.range(101).select("id", (F.col("id") % 4).alias("c"))
    sizes = assign_folds(df, folds=5, label="c", key=["id"]).groupBy("c", "fold").count().collect()
    for c in range(4):
        mine = [r["count"] for r in sizes if r["c"] == c]
        assert len(mine) == 5 and max(mine) - min(mine) <= 1


def test_running_totals_keep_missing(spark, monkeypatch):
    """NULL and NaN stay, whatever the number of cells; NULL groups are groups."""
    nan = float("nan")
    values = [(g, x, 1) for g in (None, 1) for x in (None, nan, *map(float, range(100)), float("inf"))]
    df = spark.createDataFrame(values, "g int, x double, n bigint")
    seen = []
    for size in (500_000, 7):
        monkeypatch.setattr(O, "ROWS_PER_RANGE_CELL", size)
        for ascending in (True, False):
            rows = O.running_totals(df, order="x", sums=["n"], by=["g"], ascending=ascending).collect()
            assert len(rows) == len(values)
            found = {(r["g"], str(r["x"])): r["cum_n"] for r in rows}
            ends = (found[None, "None"], found[None, "nan"], found[1, "0.0"], found[1, "inf"])
            assert ends == ((1, 103, 2, 102) if ascending else (103, 1, 102, 2))
            seen.append(sorted(found.items(), key=str))
    assert seen[0] == seen[2] and seen[1] == seen[3]
