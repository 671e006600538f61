"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tablewright.catalog import load_catalog
from tablewright.catalog.base import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
load_catalog()  # the queries of the optional subpackage have tests of their own
# model queries without SQL are slow; the model tests cover their code on small frames
WITHOUT_SQL = [n for n in QUERIES if n not in ORACLES and not n.startswith(("model_", "automl_"))]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], duck) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[:3] == ["position", "column", "count"]
    assert df.count() == 8


def test_names_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())
