"""SentencePiece encoding and decoding against the library, and its odd cases."""

import os
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablewright.llm.pieces import PieceVocabulary, decode_pieces, encode_pieces
from tablewright.llm.queries import PIECE_MODEL, QUERIES
from tests.llm.brute import sha

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODEL = public_tokenizers.path(PIECE_MODEL)
TEXTS = [
    None, "", " ", "   ", "  a  b", "a ", " a", "a\nb\t\x00c", "▁x", "▁", " ▁ ", "<s> <0x0A> </s> <unk>", "ﬁ １２ ⁇", "中文字 日本",
    "é é", "﻿x", "😀😀", "1234 5678", "\r\n\r\n", "don't (stop)... now!", "    " * 40 + "z", "ab" * 3000, "日本" * 800,
    " ".join(f"word{i % 977} x{i}" for i in range(40_000)), "same", "same",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_text_of_the_table(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for d, t in docs:
        ids = library.encode(t or "")
        expected.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    got = QUERIES["op11_piece_agenda"](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_odd_texts(spark, library):
    rows = [(i if i % 5 else None, t, t, 1, True) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, _coded int, decoded boolean")
    got = encode_pieces(df, MODEL).select("doc_id", "ids", "agrees", "decoded", decode_pieces("ids", MODEL).alias("t")).collect()
    coded = [library.encode(t or "") for _, t, *_ in rows]
    expected = [(r[0], ids, True, library.decode(ids), library.decode(ids)) for r, ids in zip(rows, coded, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert encode_pieces(df.limit(0), MODEL).count() == 0
    nothing = spark.range(2).select(F.lit(None).cast("array<int>").alias("ids"))
    assert [r[0] for r in nothing.select(decode_pieces("ids", MODEL)).collect()] == ["", ""]


def test_decoding_of_any_ids(library):
    vocabulary, rng = PieceVocabulary(MODEL), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(32_000)]) for _ in range(rng.randrange(12))]
        assert vocabulary.decode(ids) == library.decode(ids)


def test_agenda_takes_the_best_pair_first_and_then_the_leftmost():
    vocabulary = PieceVocabulary(MODEL)
    vocabulary.scores = {"ab": -1.0, "bc": 0.0, "aa": -2.0}
    assert vocabulary.merge("abc") == ["a", "bc"]
    assert vocabulary.merge("aaa") == ["aa", "a"]
    assert vocabulary.merge("") == [] and vocabulary.merge("x") == ["x"]


def test_disagreement_is_told_and_parts_leave_the_store():
    vocabulary = PieceVocabulary(MODEL)
    vocabulary.scores = {k: -v for k, v in vocabulary.scores.items()}  # the wrong order
    coded, agree = vocabulary.encode(["something different entirely", "a"])
    assert agree == [False, True] and len(coded) == 2
    assert all(len(part) <= 64 for part in PieceVocabulary(MODEL).known)
    fresh = PieceVocabulary(MODEL)
    fresh.encode(["x" * 1000])
    assert fresh.known == {} or max(map(len, fresh.known)) <= 64
