"""Periodic runs against a lag by lag comparison, and odd cases."""

import os
import random

import numpy as np
import pytest

from tablewright.llm.periodic import find_runs, repeat_tails, runs_of_documents, scan_lags, split_by_frequency
from tablewright.llm.queries import QUERIES
from tests.llm import brute

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_text_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_frequency_split_runs"](spark, FOLDER)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == brute.periodic(docs)


def test_random_words():
    rng, lists = random.Random(5), []
    for _ in range(3000):
        w = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(rng.choice((8, 40, 150))))]
        for _ in range(rng.randrange(4) if w else 0):
            start, period = rng.randrange(len(w)), rng.randrange(1, 12)
            for i in range(start + period, min(len(w), start + rng.randrange(60))):
                w[i] = w[i - period]
        lists.append(w)
    assert runs_of_documents(lists) == [brute.periodic_runs(w) for w in lists]


def test_splitting_recurs_to_stability():
    text = "a b x a b y a b z a b a b a b a b a b q a".split()
    numbers = {w: i for i, w in enumerate(dict.fromkeys(text))}
    codes = np.array([numbers[w] for w in text])
    assert split_by_frequency(codes, np.zeros(len(codes), np.int64), 6, 4) == [(9, 19)]
    assert split_by_frequency(codes[:0], codes[:0], 6, 4) == []
    # words that are frequent in two documents together are rare in each
    assert split_by_frequency(np.zeros(10, np.int64), np.repeat([0, 1], 5), 6, 4) == []
    assert split_by_frequency(np.zeros(12, np.int64), np.repeat([0, 1], 6), 6, 4) == [(0, 6), (6, 12)]


def test_long_runs_are_compared_once():
    for n, period in ((200_000, 1), (200_000, 7), (120_000, 30_000)):
        words = np.arange(n) % period
        assert scan_lags(words, 6, 4) == [(0, n, period)]


def test_odd_rows(spark):
    long = " ".join(["so"] * 70_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x\ny " * 4), (None, None), (5, long), (6, "a a a a a"),
            (7, "a b " * 6)]
    df = spark.createDataFrame([(*r, "n", 1, 2.0) for r in rows], "doc_id long, text string, runs string, _found int, n_words double")
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in find_runs(df).collect()}
    assert got == {
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 6, ((0, 6, 1),), "a"), (None, 8, ((0, 8, 2),), "x y"), (None, 0, (), ""),
        (5, 70_000, ((0, 70_000, 1),), "so"), (6, 5, (), "a a a a a"), (7, 6, ((0, 6, 1),), "a b"),
    }
    assert find_runs(df).count() == len(rows)
    assert find_runs(df.limit(0)).count() == 0 and repeat_tails(df.limit(0)).count() == 0
    tails = {r.doc_id: r.text for r in repeat_tails(df).collect()}
    assert tails[1] == "" and len(tails) == 8
    with pytest.raises(ValueError):
        find_runs(df, exponent=1)
