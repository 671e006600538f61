"""The registered queries over the smallest tables, against plain versions and SQL."""

import os

import pytest

from tablewright.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], connect(FOLDER)) == []


def test_token_records(spark, docs):
    got = QUERIES["op1_token_records"](spark, FOLDER)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == brute.token_records(docs)


def test_packing(spark, docs):
    got = QUERIES["op2_hierarchical_packing"](spark, FOLDER)
    brute.check_packing(docs, rows(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))


def test_substrings(spark, docs):
    got = QUERIES["op3_count_min_substrings"](spark, FOLDER)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(docs)


def test_similar_groups(spark, docs):
    got = QUERIES["op9_rare_first_jaccard"](spark, FOLDER)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute.jaccard_components(docs)


def test_secrets_are_counted_by_kind_wherever_they_stand(spark, tmp_path):
    hexes = ["0123456789abcdef" * 2, "f" * 40]
    texts = ["x " + hexes[0], f"{hexes[0]} token=abcdefgh {hexes[1]} AKIAABCDEFGHIJ12 secret: 12345678", "AKIAABCDEFGHIJKLM", None, "token=abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_trigram_secrets"](spark, str(tmp_path))
    expected = [(0, 0, 0, 1), (1, 2, 1, 2), (2, 0, 1, 0), (3, 0, 0, 0), (4, 0, 0, 0)]
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex") == expected
