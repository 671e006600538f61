"""Token ids as length-delimited binary records with checksums, and a separate offset index.

A record: length of the payload (8 bytes), masked checksum of these 8 bytes (4), payload, masked
checksum of the payload (4), and the terminator 0x0A (1). All numbers are little-endian. The
payload: 1 if there is a document id, else 0 (1 byte), the id (8, signed), bytes a token id (1),
the token ids. The checksum is CRC-32, masked as in other record files: rotated right by 15 bits,
plus a constant, since a checksum over data that holds its own checksum is weak.

Files are written by Spark's own text writer from raw bytes, so its commit protocol covers lost
executors and every store that Spark writes to; the terminator is what that writer adds to a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import as_bytes, chunks, select_texts, shuffle_partitions, word_tokens

#: The mask of the checksums.
MASK_DELTA = 0xA282EAD8
HEAD, HEAD_BYTES = "<QI", 12
PAYLOAD, PAYLOAD_BYTES = "<?qB", 10
#: Bytes of text for one file; its ids take about half of that.
FILE_BYTES = 128 << 20
OUT_BYTES = 4 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record without its terminator."""
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))])


def unframe(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length (without the terminator) and payload of each record of a file; damage raises."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + HEAD_BYTES > len(data):
            raise ValueError(f"the file ends inside the record at {at}")
        n, crc = struct.unpack_from(HEAD, data, at)
        if masked_crc(bytes(view[at : at + 8])) != crc:
            raise ValueError(f"the length of the record at {at} is damaged")
        end = at + HEAD_BYTES + n + 4
        if end + 1 > len(data):
            raise ValueError(f"the file ends inside the record at {at}")
        payload = bytes(view[at + HEAD_BYTES : end - 4])
        if masked_crc(payload) != struct.unpack_from("<I", data, end - 4)[0] or data[end] != 10:
            raise ValueError(f"the record at {at} is damaged")
        yield at, end - at, payload
        at = end + 1


def _files_for(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // FILE_BYTES))


def write_token_records(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, *,
    id_col: str = "doc_id", text_col: str = "text", files: int | None = None,
) -> None:
    """Encode every whole text, append ``end_id``, and write records below ``path/records`` in
    ascending order of ids (null ids first, equal ids by text), and the index below ``path/index``.

    ``files`` (default: one for ``FILE_BYTES`` of text, and as many as the session's shuffle partitions
    at least) sets the number of files; a reader holds one at a time. Empty and null texts give a
    record with the end id only, repeated rows a record each; an empty table gives no record. A text is
    one record, however long; columns may have any names.
    """
    n = files or _files_for(docs, text_col)
    tie = F.xxhash64("text")  # rows of one id, also of none, spread over files
    ordered = select_texts(docs, id_col, text_col).repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def encode(batches):
        tokens = word_tokens(tokenizer)
        end = int(end_id).to_bytes(tokens.width, "little")
        for batch in batches:
            out, size = [], 0
            for ids, texts in chunks(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                for doc, enc in zip(ids, tokens.ids(texts), strict=True):
                    out.append(frame(struct.pack(PAYLOAD, doc is not None, doc or 0, tokens.width) + enc + end))
                    size += len(out[-1])
                if size > OUT_BYTES:
                    yield pa.record_batch({"value": pa.array(out, pa.binary())})
                    out, size = [], 0
            if out:
                yield pa.record_batch({"value": pa.array(out, pa.binary())})

    ordered.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.text(f"{path}/records")
    _parsed(docs.sparkSession, path, with_ids=False).write.parquet(f"{path}/index")


def _parsed(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """The records of all files: file, its number, offset, length, doc_id, n_tokens, the ids before
    it in its file, and the ids as 32-bit integers if asked for."""
    fields = "file string, file_number long, offset long, length long, doc_id long, n_tokens long, start_in_file long"

    def parse(batches):
        for batch in batches:
            for name, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                file, before, rows, size = name.rpartition("/")[2], 0, [], 0
                number = int(file.split("-")[1])
                for offset, length, payload in unframe(content):
                    known, doc, width = struct.unpack_from(PAYLOAD, payload)
                    ids = payload[PAYLOAD_BYTES :]
                    n = len(ids) // width
                    rows.append((file, number, offset, length, doc if known else None, n, before))
                    if with_ids:
                        wide = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                        rows[-1] += (wide,)
                        size += len(wide)
                    before += n
                    if size > OUT_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]
        names = ["file", "file_number", "offset", "length", "doc_id", "n_tokens", "start_in_file", "ids"]
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    files = spark.read.format("binaryFile").load(f"{path}/records").select("path", "content")
    return files.mapInArrow(parse, fields + (", ids binary" if with_ids else ""))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index with ``start``: the ids of all records before one, over all files.

    The one unpartitioned window has a row for each file, not for each record.
    """
    index = spark.read.parquet(f"{path}/index")
    by_file = index.groupBy("file_number").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    base = by_file.select("file_number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(base, "file_number").withColumn("start", F.col("base") + F.col("start_in_file")).drop("base", "start_in_file")


def shuffled_index(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """The index in a seeded order, for readers that seek: file, offset and length of each record."""
    return read_index(spark, path).orderBy(F.xxhash64(F.lit(seed), "file_number", "offset"), "file_number", "offset")


def read_token_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record, checked: doc_id, file_number, offset, n_tokens, ids (little-endian unsigned 32-bit)."""
    return _parsed(spark, path, with_ids=True).select("doc_id", "file_number", "offset", "n_tokens", "ids")
