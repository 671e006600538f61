"""CSV with line breaks inside quotes, in many splits, against one plain parser."""

import csv
import io
import random

import pytest

from tablewright.errors import DataLoadError
from tablewright.sources import tables as S
from tablewright.sources.csv_records import csv_records, inside_after


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def cell(rng):
    return "".join(rng.choice(["a", "bc", '"', ",", "\n", "\r", "\r\n", " ", "é", "x" * 40]) for _ in range(rng.randrange(8)))


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_cells_in_many_splits(spark, small_splits, tmp_path, end):
    rng = random.Random(1)
    rows = [(str(i), cell(rng), cell(rng)) for i in range(300)]
    rows[150] = ("150", "long\n" * 400, '"' * 50)  # longer than several splits
    path = tmp_path / "t.csv"
    path.write_bytes(written([("id", "a", "b"), *rows], end).encode())
    df = S.read_csv(spark, str(path), "id string, a string, b string", missing=())
    assert csv_records(spark, str(path)).rdd.getNumPartitions() > 10
    assert sorted(map(tuple, df.collect())) == sorted(rows)


def test_many_files_with_headers_and_empty_lines(spark, small_splits, tmp_path):
    rng = random.Random(2)
    rows = [(str(i), cell(rng)) for i in range(120)]
    for k in range(3):
        text = written([("id", "text"), *rows[k * 40 : k * 40 + 40]])
        (tmp_path / f"{k}.csv").write_bytes(("﻿" * (k == 0) + text + "\n\n").encode())
    (tmp_path / "3.csv").write_text("id,text\n")
    (tmp_path / "4.csv").write_text("")
    df = S.read_csv(spark, str(tmp_path), missing=())
    assert df.columns == ["id", "text"]
    assert sorted((str(a), b) for a, b in df.collect()) == sorted(rows)


def test_unquoted_cells_and_stray_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('n,s,f\n1,5" pipe,2.5\n2,,NA\n3,"a ""b"" c\nd",-1e3\n4,plain,\n')
    df = S.read_csv(spark, str(path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("n", "int"), ("s", "string"), ("f", "double")]
    assert sorted(map(tuple, df.collect())) == [(1, '5" pipe', 2.5), (2, None, None), (3, 'a "b" c\nd', -1000.0), (4, "plain", None)]
    assert S.read_table(spark, str(path), multiline=False, missing=("plain",)).filter("n = '4'").first()["s"] is None


def test_names_of_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,,"b\nb",A,with.dot\n1,2,3,4,5\n')
    df = S.read_csv(spark, str(path))
    assert df.columns == ["a0", "_c1", "b\nb", "A3", "with.dot"] and tuple(df.first()) == (1, 2, 3, 4, 5)


def test_empty_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("")
    with pytest.raises(DataLoadError):
        S.read_table(spark, str(path))
    path.write_text("a,b\n")
    with pytest.raises(DataLoadError):
        S.read_table(spark, str(path))


def test_open_cells():
    for line, inside, after in (
        ("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('"",""', False, False),
        ('x"y', False, False), ('end",next', True, False), ('end""', True, True), ('end" still', True, True), ('end"\r', True, False),
        ('end","again', True, True), ("", True, True), ("", False, False), ('"', True, False), ('"', False, True),
    ):
        assert inside_after(line, inside) == after, (line, inside)
