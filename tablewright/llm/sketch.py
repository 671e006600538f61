"""A count-min sketch of windows of words, merged from the sketches of buckets of documents.

Documents are dealt into buckets. Each bucket makes its part of the sketch: for each row of
counters the cells of its windows, with the number of its documents that hold them. Parts are
sent by blocks of neighbouring cells and merged there; each bucket then gets back those of its own
cells that more than one document fills, with their merged counts. The smallest of a window's
counts is never below the number of documents that hold it, so a window that is estimated to be
in one document is in one document.

The sketch has two rows of about four cells a window or, where what travels matters more, one row of
about sixteen, which errs about as often. It is never in one place: its width follows the size of the input,
as do the numbers of buckets and blocks. Cells travel as sorted numbers in Elias and Fano's code: two
bits each besides those of the mean gap, which grows with the number of buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Words, as_bytes, chunks, forget_stores, shuffle_partitions, window_hashes

ROWS = 2
MOST = 255  # counts stop here
BUCKET_BYTES = 8 << 20
BLOCK_CELLS_BITS = {1: 23, 2: 22}  # by rows of the sketch, as below
_BYTES_A_WINDOW = 6  # a word and its space, about
_CELLS_A_WINDOW = {1: 16, 2: 4}
_LEAST_ENTRIES = 256  # of a part in a block


@dataclass(frozen=True)
class Shape:
    """What the sketch is made for: windows of ``size`` words, with ASCII letters in lower case if
    ``lower``, documents with fewer words as one window if ``short``; and its numbers, ``rows`` of them
    rows of counters."""

    size: int
    lower: bool
    short: bool
    buckets: int
    width_bits: int
    block_bits: int
    rows: int = ROWS


def shape_for(rows: DataFrame, size: int, *, lower: bool = False, short: bool = False, bucket_bytes: int = BUCKET_BYTES,
              sketch_rows: int = ROWS) -> Shape:
    """Numbers of the sketch for rows with a ``text``, from their bytes."""
    n = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(rows.sparkSession), math.ceil(n / bucket_bytes))
    width = max(16, math.ceil(math.log2(max(1, n / _BYTES_A_WINDOW * _CELLS_A_WINDOW[sketch_rows]))))
    entries = n / _BYTES_A_WINDOW / buckets / _LEAST_ENTRIES
    blocks = max(0, min(width - BLOCK_CELLS_BITS[sketch_rows], math.ceil(math.log2(max(1, entries)))))
    return Shape(size, lower, short, buckets, width, blocks, sketch_rows)


def bucketed(rows: DataFrame, shape: Shape) -> DataFrame:
    """``bucket, doc_id, text``: rows of one id, also of none, are dealt out by their text."""
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shape.buckets)).cast("int")
    return rows.select(bucket.alias("bucket"), "doc_id", "text")


@dataclass
class Windows:
    """The windows of some documents: two hashes each, first and last word, and document."""

    words: Words
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, texts: list[bytes], shape: Shape) -> Windows:
        words = Words(texts, shape.lower)
        first, last = words.windows(shape.size, shape.short)
        return cls(words, first, last, words.doc[first], window_hashes(words, first, last, shape.size))

    def of_documents(self) -> np.ndarray:
        """One window for each distinct first hash of a document, in the documents' order."""
        ends = np.searchsorted(self.doc, np.arange(len(self.words.counts) + 1))
        found = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b > a:
                found.append(a + np.unique(self.hashes[0][a:b], return_index=True)[1])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def cells(h: np.ndarray, shape: Shape) -> np.ndarray:
    return h >> np.uint64(64 - shape.width_bits)


def pack_gaps(values: np.ndarray) -> bytes:
    """Sorted distinct numbers: the lowest bits of each as they are, about as many as the mean gap has, and the
    rest as a bitmap with a one for each number and a zero for each step of the rest. Before both a byte
    with the number of low bits and four with how many numbers there are."""
    n = len(values)
    if not n:
        return b""
    values = values.astype(np.int64)
    low = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
    bits = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    places = (values >> low) + np.arange(n)
    steps = np.zeros(int(places[-1]) + 1, np.uint8)
    steps[places] = 1
    return bytes([low]) + n.to_bytes(4, "little") + np.packbits(bits).tobytes() + np.packbits(steps).tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    low, n = data[0], int.from_bytes(data[1:5], "little")
    steps = 5 + -(-n * low // 8)
    places = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=steps)))
    values = (places - np.arange(n)) << low
    if low:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, steps - 5, 5), count=n * low).reshape(n, low)
        for k in range(low):
            values |= bits[:, k].astype(np.int64) << k
    return values


_PART = "sketch_row int, block int, bucket int, gaps binary, more binary, counts binary"


def _parts(shape: Shape):
    """The parts of one bucket's sketch: cells, and those (by place) with a count above one."""

    def make(table: pa.Table) -> pa.Table:
        forget_stores()
        bucket = table["bucket"][0].as_py()
        held: list[list[np.ndarray]] = [[] for _ in range(shape.rows)]
        texts = as_bytes(table["text"].combine_chunks())
        for _, part in chunks(texts, texts):
            w = Windows.of(part, shape)
            one = w.of_documents()
            for r in range(shape.rows):
                held[r].append(cells(w.hashes[r][one], shape))
        rows = []
        local = np.uint64(shape.width_bits - shape.block_bits)
        for r in range(shape.rows):
            all_cells = np.concatenate(held[r]) if held[r] else np.zeros(0, np.uint64)
            found, n = np.unique(all_cells, return_counts=True)
            n = np.minimum(n, MOST).astype(np.uint8)
            edges = np.searchsorted(found, np.arange((1 << shape.block_bits) + 1, dtype=np.uint64) << local)
            for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if j > i:
                    more = np.flatnonzero(n[i:j] > 1)
                    here = found[i:j] & ((np.uint64(1) << local) - np.uint64(1))
                    rows.append((r, b, bucket, pack_gaps(here), pack_gaps(more), n[i:j][more].tobytes()))
        return _table(rows, _PART)

    return make


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table({n: pa.array(c, kinds[k]) for c, (n, k) in zip(columns, names, strict=True)})


def _merge(shape: Shape):
    """Merge a block's parts and give each bucket its cells that several documents fill."""

    def merge(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        total = np.zeros(1 << (shape.width_bits - shape.block_bits), np.uint8)
        for p in parts:
            at = unpack_gaps(p["gaps"])
            n = np.ones(len(at), np.uint16)
            n[unpack_gaps(p["more"])] = np.frombuffer(p["counts"], np.uint8)
            total[at] = np.minimum(total[at] + n, MOST)
        rows = []
        for p in parts:
            at = unpack_gaps(p["gaps"])
            at = at[total[at] > 1]
            if len(at):
                rows.append((p["sketch_row"], p["block"], p["bucket"], pack_gaps(at), total[at].tobytes()))
        return _table(rows, _SHARED)

    return merge


_SHARED = "sketch_row int, block int, bucket int, gaps binary, counts binary"


def shared_cells(dealt: DataFrame, shape: Shape) -> DataFrame:
    """``sketch_row, block, bucket, gaps, counts``: for each bucket its cells with counts above one."""
    parts = dealt.groupBy("bucket").applyInArrow(_parts(shape), _PART)
    return parts.groupBy("sketch_row", "block").applyInArrow(_merge(shape), _SHARED)


class Estimates:
    """The counts that a bucket got back."""

    def __init__(self, table: pa.Table, shape: Shape):
        self.shape, self.rows = shape, []
        local = shape.width_bits - shape.block_bits
        got = sorted(table.select(["sketch_row", "block", "gaps", "counts"]).to_pylist(), key=lambda p: (p["sketch_row"], p["block"]))
        for r in range(shape.rows):
            own = [p for p in got if p["sketch_row"] == r]
            at = [unpack_gaps(p["gaps"]) + (p["block"] << local) for p in own]
            counts = b"".join([p["counts"] for p in own])
            self.rows.append((np.concatenate([np.zeros(0, np.int64), *at]), np.frombuffer(counts, np.uint8)))

    def counts(self, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each window the smallest of its counts; 1 if a row sent none back."""
        least = np.full(len(hashes[0]), MOST, np.uint8)
        for (known, counts), h in zip(self.rows, hashes[: self.shape.rows], strict=True):
            if not len(known):
                return np.ones(len(h), np.uint8)
            c = cells(h, self.shape).astype(np.int64)
            at = np.minimum(np.searchsorted(known, c), len(known) - 1)
            least = np.minimum(least, np.where(known[at] == c, counts[at], 1))
        return least
