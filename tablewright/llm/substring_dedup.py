"""Removal of word sequences that stand in an earlier document.

A window is a number of consecutive words of one document. A count-min sketch (see ``sketch``)
tells which windows may stand in several documents; it never says too few, so none is lost. Only
these are then grouped exactly, by 128-bit fingerprints, to find the smallest document of each;
windows that the sketch overestimated turn out to be single. A word that a window covers which
stands in a smaller document too is removed; windows are judged on the input.

Each bucket of documents reads its texts three times from one and the same shuffle: for the
sketch, for its candidates, and to remove. What travels in between are packed arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import as_bytes, chunks, select_texts
from tablewright.llm.sketch import BUCKET_BYTES, Estimates, Shape, Windows, bucketed, shape_for, shared_cells

WINDOW_WORDS = 13
NO_ID = 2**63 - 1  # a null id comes after all others
ENTRIES = "bucket int, part int, h1 binary, h2 binary, docs binary, several binary"
FIRSTS = "bucket int, h1 binary, h2 binary, docs binary"
KEPT = "doc_id long, n_words long, n_removed long, text string"


def planes(values: np.ndarray) -> bytes:
    """8-byte numbers with equal places next to each other, which compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _gaps(sorted_values: np.ndarray) -> bytes:
    return planes(np.diff(sorted_values, prepend=np.uint64(0)))


def _from_gaps(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _ids(table: pa.Table) -> list[int]:
    return table["doc_id"].combine_chunks().fill_null(NO_ID).to_pylist()


def _candidates(shape: Shape, parts_bits: int):
    """A bucket's windows that may be repeated: fingerprint, smallest document here, and whether
    several documents here have it; by the fingerprint's first bits."""

    def find(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        estimates = Estimates(right, shape)
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            for ids, texts in chunks(_ids(left), as_bytes(left["text"].combine_chunks())):
                w = Windows.of(texts, shape)
                may = np.flatnonzero(estimates.counts(w.hashes) > 1)
                found[0].append(w.hashes[0][may])
                found[1].append(w.hashes[1][may])
                found[2].append(np.array(ids, np.int64)[w.doc[may]])
        h1, h2, docs = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.uint64, np.uint64, np.int64), strict=True))
        order = np.lexsort((docs, h2, h1))
        h1, h2, docs = h1[order], h2[order], docs[order]
        first = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(h1)]
        start = np.flatnonzero(first)
        last = docs[np.r_[start[1:], len(docs)] - 1] if len(start) else docs
        several = (last > docs[start]).astype(np.uint8)
        h1, h2, docs = h1[start], h2[start], docs[start]
        edges = np.searchsorted(h1, np.arange(1, 1 << parts_bits, dtype=np.uint64) << np.uint64(64 - parts_bits)) if parts_bits else []
        edges = [0, *edges, len(h1)]
        rows = [
            (bucket, p, _gaps(h1[i:j]), planes(h2[i:j]), planes(docs[i:j]), several[i:j].tobytes())
            for p, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i
        ]
        cols = list(zip(*rows, strict=True)) or [[] for _ in range(6)]
        names = [f.split()[0] for f in ENTRIES.split(", ")]
        return pa.table([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(cols)], names)

    return find


def _smallest(table: pa.Table) -> pa.Table:
    """Group the candidates of one part exactly, and tell each bucket the smallest document of
    those of its windows that stand in a smaller document or in several of its own."""
    rows = table.to_pylist()
    h1, h2 = [_from_gaps(r["h1"]) for r in rows], [from_planes(r["h2"], np.uint64) for r in rows]
    docs = [from_planes(r["docs"], np.int64) for r in rows]
    sizes = np.fromiter(map(len, h1), np.int64, len(rows))
    source = np.repeat(np.arange(len(rows)), sizes)
    a, b, d = np.concatenate(h1), np.concatenate(h2), np.concatenate(docs)
    several = np.concatenate([np.frombuffer(r["several"], np.uint8) for r in rows]).astype(bool)
    order = np.lexsort((d, b, a))
    a, b, d, source, several = a[order], b[order], d[order], source[order], several[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
    told = (least < d) | several
    out = []
    back = np.argsort(source[told], kind="stable")
    a, b, least, source = (x[told][back] for x in (a, b, least, source))
    edges = np.searchsorted(source, np.arange(len(rows) + 1))
    for r, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if j > i:
            out.append((rows[r]["bucket"], _gaps(a[i:j]), planes(b[i:j]), planes(least[i:j])))
    cols = list(zip(*out, strict=True)) or [[] for _ in range(4)]
    return pa.table([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(cols)], [f.split()[0] for f in FIRSTS.split(", ")])


def _removal(shape: Shape):
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pylist()
        empty = np.zeros(0, np.uint64)
        h1 = np.concatenate([empty, *[_from_gaps(r["h1"]) for r in told]])
        h2 = np.concatenate([empty, *[from_planes(r["h2"], np.uint64) for r in told]])
        least = np.concatenate([np.zeros(0, np.int64), *[from_planes(r["docs"], np.int64) for r in told]])
        order = np.argsort(h1, kind="stable")
        h1, h2, least = h1[order], h2[order], least[order]
        out = [[], [], [], []]
        if left.num_rows:
            for ids, texts in chunks(_ids(left), as_bytes(left["text"].combine_chunks())):
                w = Windows.of(texts, shape)
                covered = np.zeros(len(w.words.doc) + 1, np.int64)
                if len(h1):
                    own = np.array(ids, np.int64)[w.doc]
                    at = np.searchsorted(h1, w.hashes[0])
                    hit = np.zeros(len(own), bool)
                    live = np.flatnonzero(at < len(h1))
                    while len(live):  # more than one round only if first hashes clash
                        same = h1[at[live]] == w.hashes[0][live]
                        live = live[same]
                        hit[live] |= (h2[at[live]] == w.hashes[1][live]) & (least[at[live]] < own[live])
                        at[live] += 1
                        live = live[at[live] < len(h1)]
                    np.add.at(covered, w.first[hit], 1)
                    np.add.at(covered, w.last[hit] + 1, -1)
                gone = np.cumsum(covered)[:-1] > 0
                at = 0
                for doc, words in zip(ids, w.words.split, strict=True):
                    g = gone[at : at + len(words)]
                    at += len(words)
                    n = int(g.sum())
                    kept = words if not n else [x for x, y in zip(words, g.tolist(), strict=True) if not y]
                    for column, value in zip(out, (None if doc == NO_ID else doc, len(words), n, b" ".join(kept)), strict=True):
                        column.append(value)
        texts = pa.array(out[3], pa.binary()).cast(pa.string())
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_words": pa.array(out[1], pa.int64()),
                         "n_removed": pa.array(out[2], pa.int64()), "text": texts})

    return remove


def remove_repeats(docs: DataFrame, *, words: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: each row with the words that stay, joined by spaces.

    Null and empty texts have no words, shorter ones than a window lose none. A null id comes
    after all ids: such rows lose what stands in rows with an id. Rows of one id are not smaller
    than each other. ``bucket_bytes`` is the text that one task holds at a time.
    """
    rows = select_texts(docs, id_col, text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    shape = shape_for(rows, words, bucket_bytes=bucket_bytes)
    dealt = bucketed(rows, shape)
    parts_bits = max(0, shape.buckets.bit_length() - 1)
    shared = shared_cells(dealt, shape)
    by_bucket = dealt.groupBy("bucket")
    entries = by_bucket.cogroup(shared.groupBy("bucket")).applyInArrow(_candidates(shape, parts_bits), ENTRIES)
    firsts = entries.groupBy("part").applyInArrow(_smallest, FIRSTS)
    return by_bucket.cogroup(firsts.groupBy("bucket")).applyInArrow(_removal(shape), KEPT)
