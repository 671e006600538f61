"""Exact deduplication by recipes of content-defined chunks.

A text without its white space is cut where a rolling hash of its last bytes says so, hence equal
stretches are cut alike wherever they stand. Chunks move once to be compared byte by byte: a hash
that one content has is a verified identifier. Documents then meet as the ordered lists of their
chunks' identifiers, a small fraction of their size. Documents with an identifier that two
contents share (none is to be expected at 128 bits) are told apart by a further digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SPACE_BYTES, as_bytes, forget_stores, join_hot, packed, select_texts, unpacked
from tablewright.session import cut_lineage

AVERAGE_BITS = 11  # a cut at one of 2048 places
SMALLEST, LARGEST = 512, 16_384
ID_BYTES = 16
OUT_BYTES = 4 << 20
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def cut_places(data: np.ndarray, bits: int = AVERAGE_BITS, smallest: int = SMALLEST, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks of a text (bytes). A cut depends on the 16 bytes before it; chunks have
    ``smallest`` to ``largest`` bytes, but for the last."""
    n = len(data)
    if n <= smallest:
        return [n] if n else []
    h = _GEAR[data]
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8):  # sums of 2, 4, 8 and 16 shifted values
            h[step:] += h[:-step].copy() << np.uint32(step)
    marks = (np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1).tolist()
    ends, last = [], 0
    for m in marks:
        while m - last > largest:
            last += largest
            ends.append(last)
        if m - last >= smallest:
            ends.append(m)
            last = m
    while n - last > largest:
        last += largest
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunks_of(text: bytes) -> list[bytes]:
    bare = text.translate(None, SPACE_BYTES)
    ends = cut_places(np.frombuffer(bare, np.uint8))
    return [bare[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def distinct_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``chunk_hash, content``: the chunks of all documents, each once for a task and batch."""

    def cut(batches):
        forget_stores()
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            out, size = [], 0
            for text in as_bytes(batch.column(0)):
                for chunk in _chunks_of(text):
                    key = xxhash.xxh3_128_digest(chunk)
                    if seen.get(key) == chunk:
                        continue
                    seen[key] = chunk
                    out.append((key, chunk))
                    size += len(chunk)
                if size > OUT_BYTES:
                    yield _pairs(out)
                    out, size = [], 0
            if out:
                yield _pairs(out)

    def _pairs(rows):
        keys, contents = zip(*rows, strict=True)
        return pa.record_batch({"chunk_hash": pa.array(keys, pa.binary()), "content": pa.array(contents, pa.binary())})

    return select_texts(docs, id_col, text_col).select("text").mapInArrow(cut, "chunk_hash binary, content binary")


def clashing_hashes(chunks: DataFrame) -> DataFrame:
    """Hashes that chunks of different content share."""
    least, most = F.min("content"), F.max("content")
    return chunks.groupBy("chunk_hash").agg(least.alias("a"), most.alias("b")).filter("a <> b").select("chunk_hash")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, recipe, text_sha256``: of each row the characters of its text as it is,
    the list of its chunks' identifiers in one value, and the digest of its normalised text."""

    def digest(batches):
        forget_stores()
        for batch in batches:
            found, shas, counts = [], [], []
            for text in as_bytes(batch.column(1)):
                parts = _chunks_of(text)
                found.append(b"".join([xxhash.xxh3_128_digest(c) for c in parts]))
                sha = hashlib.sha256()
                for c in parts:
                    sha.update(c)
                shas.append(sha.hexdigest())
                counts.append(len(text.decode()))
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_chars": pa.array(counts, pa.int64()),
                "recipe": pa.array(found, pa.binary()), "text_sha256": pa.array(shas, pa.string()),
            })

    rows = select_texts(docs, id_col, text_col)
    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, recipe binary, text_sha256 string")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``, and
    ``n_chars`` of the text as it is and ``copies``, the rows alike in id, text and length.

    Texts are equal if they are without the characters 0x20 and 0x09-0x0D; null and empty texts
    are equal to each other and to texts of white space. Of equal texts the longest as it stands
    is kept, then the smallest id (a null id comes last); of rows that agree in both, exactly one.
    """
    rows = recipes(docs, id_col, text_col)
    clash = cut_lineage(clashing_hashes(distinct_chunks(docs, id_col, text_col)))
    if clash.isEmpty():
        rows = rows.withColumn("apart", F.lit(""))
    else:
        rows = _told_apart(rows, clash)
    key = ["recipe", "apart"]
    rows = rows.groupBy(*key, "doc_id", "n_chars", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    best = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"))
    groups = rows.groupBy(*key).agg(
        F.max_by("doc_id", best).alias("keep_id"), F.max(best).alias("best"), F.sum("copies").alias("group_size")
    )
    joined = join_hot(rows.withColumn("place", best), groups, key)
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = (F.col("copy") == 1) & F.col("place").eqNullSafe(F.col("best"))
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_chars", "copies")


def _told_apart(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """Add ``apart``: the text's digest for documents with an identifier of several contents."""
    n_ids = F.floor(F.length("recipe") / ID_BYTES).cast("int")
    places = F.when(n_ids > 0, F.sequence(F.lit(0), n_ids - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(places, lambda i: F.substring(F.col("recipe"), i * ID_BYTES + 1, F.lit(ID_BYTES)))
    doubtful = (
        rows.select("recipe", F.explode(pieces).alias("chunk_hash"))
        .join(clash, "chunk_hash", "left_semi").select("recipe").distinct().withColumn("doubtful", F.lit(True))
    )
    apart = F.when(F.col("doubtful"), F.col("text_sha256")).otherwise(F.lit(""))
    return rows.join(doubtful, "recipe", "left").withColumn("apart", apart).drop("doubtful")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept row of each group of equal texts, all its columns as they were.

    Of rows alike in id, text without white space and length, the smallest by its columns stays.
    Null and empty texts are equal; a null id comes last; an empty table stays empty; columns may
    have any names.
    """
    keep = cut_lineage(exact_groups(docs, id_col, text_col).filter("kept").select(
        F.struct("doc_id", "text_sha256", "n_chars").alias("place"), "copies"
    ))
    text = F.coalesce(docs[text_col], F.lit(""))
    digest = F.sha2(F.translate(text, SPACE_BYTES.decode(), ""), 256)
    place = F.struct(docs[id_col].alias("doc_id"), digest.alias("text_sha256"), F.length(text).cast("long").alias("n_chars"))
    held = packed(docs, place.alias("place"))
    found = held.join(keep.filter("copies = 1"), "place", "left_semi")
    alike = keep.filter("copies > 1")
    if not alike.isEmpty():  # they meet as aggregates, however many they are
        one = held.join(alike, "place", "left_semi").groupBy("place").agg(F.min("row").alias("row"))
        found = found.unionByName(one)
    return unpacked(found)
