"""The corpus pipeline: from raw documents to packed sequences.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again before the next stage; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.exact_dedup import drop_exact_copies
from tablewright.llm.jaccard import drop_near_copies
from tablewright.llm.language import drop_unidentified
from tablewright.llm.mixing import take_mix
from tablewright.llm.packing import pack_documents
from tablewright.session import shared_folder

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go: null texts and texts without letters."""
    return drop_unidentified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space stays."""
    return drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.75 over five words stays: that of the
    smallest id, null ids last; rows are told apart by id and text."""
    return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to two rows of one document."""
    return take_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, without the ids themselves but with their checksum."""
    pieces = pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models, balanced sampling and tokenizers are beyond SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
