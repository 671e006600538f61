"""Exact top-k search by inner product over a bit-sliced index.

The index holds, for a block of rows, one bitmap for each bit of each quantised attribute (two's
complement; the highest slice counts negative). A query's scores are added up from these slices
with bitmap arithmetic alone: each set digit of a query's value adds the attribute's slices at
that weight, and full adders carry from weight to weight. The top rows are then selected from the
most significant slice of the sum downward (O'Neil and Quass, 1997). Rows on the boundary, of
equal score, are resolved by their ids.

Blocks of rows meet chunks of the stated queries; a block sends k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 16_384
CHUNK_QUERIES, CHUNKS_A_TASK = 128, 8
ADDED_AT_ONCE = 8  # queries whose slices are added together


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    values = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), values)


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps of rows x attributes: attributes x bits x words of 64 rows, two's complement."""
    bits = max(2, int(max(abs(int(values.min())), abs(int(values.max())) + 1)).bit_length() + 1)
    rows = -(-len(values) // 64) * 64
    padded = np.zeros((rows, values.shape[1]), np.int64)
    padded[: len(values)] = values
    by_attribute = np.ascontiguousarray(padded.T)
    planes = [np.packbits((by_attribute >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)]
    return np.stack(planes, 1)


def digits(value: int) -> list[tuple[int, int]]:
    """A value as a sum of few signed powers of two: (exponent, sign), no two neighbours."""
    found, k = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            found.append((k, sign))
            value -= sign
        value >>= 1
        k += 1
    return found


def add_slices(slices: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Sums of value times attribute: queries x bits x words, two's complement.

    A subtracted slice is added inverted, with ones for its higher bits and its borrow gathered in
    a constant; the highest slice of an attribute counts negative and is treated alike:
    -b * 2**w = (1 - b) * 2**w - 2**w, so only inverted bits and a constant are left.
    """
    n_attr, bits, words = slices.shape
    flat = np.concatenate([slices.reshape(-1, words), ~slices.reshape(-1, words), np.zeros((1, words), np.uint64)])
    zero, half = len(flat) - 1, n_attr * bits
    top = int(np.abs(queries).max(initial=0)).bit_length() + 1
    width = top + bits + n_attr.bit_length() + 1
    chosen: list[list[list[int]]] = []  # query, weight: rows of flat
    constants = []
    for q in queries.tolist():
        at: list[list[int]] = [[] for _ in range(width)]
        constant = 0
        for d, value in enumerate(q):
            for k, sign in digits(value):
                for b in range(bits):
                    if (sign > 0) == (b < bits - 1):
                        at[k + b].append(d * bits + b)
                    else:
                        at[k + b].append(half + d * bits + b)
                        constant -= 1 << (k + b)
        chosen.append(at)
        constants.append(constant & ((1 << width) - 1))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    n = len(queries)
    out = np.zeros((n, width, words), np.uint64)
    carried = np.zeros((n, 0, words), np.uint64)
    for w in range(width):
        size = max(len(at[w]) for at in chosen)
        index = np.full((n, size + 1), zero)
        for i, at in enumerate(chosen):
            index[i, : len(at[w])] = at[w]
        column = np.concatenate([flat[index], carried], 1)
        ones = np.array([full if c >> w & 1 else np.uint64(0) for c in constants], np.uint64)
        column[:, size, :] = ones[:, None]
        carries = []
        while column.shape[1] > 1:
            m = column.shape[1] // 3
            if m:
                a, b, c = (column[:, i * m : (i + 1) * m] for i in range(3))
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                column = np.concatenate([ab ^ c, column[:, 3 * m :]], 1)
            else:  # two are left
                a, b = column[:, :1], column[:, 1:]
                carries.append(a & b)
                column = a ^ b
        out[:, w] = column[:, 0] if column.shape[1] else 0
        carried = np.concatenate(carries, 1) if carries else carried[:, :0]
    return out


def select_top(sums: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of at least the ``k`` rows of the highest sums, with all that tie with the last.

    sums: bits x words; live: rows that take part.
    """
    sure, tied = np.zeros_like(live), live.copy()
    slices = [~sums[-1], *sums[-2::-1]]  # the sign's slice inverted: the larger, the higher
    for s in slices:
        above = sure | (tied & s)
        n = int(np.bitwise_count(above).sum())
        if n > k:
            tied &= s
        else:
            sure = above
            tied &= ~s
            if n == k:
                return sure
    return sure | tied


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_in_block(ids: np.ndarray, values: np.ndarray, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """query, row and score of each query's best ``k`` rows of a block, rows of its own id apart."""
    live = np.packbits(np.r_[np.ones(len(ids), np.uint8), np.zeros(slices.shape[2] * 64 - len(ids), np.uint8)], bitorder="little").view(np.uint64)
    found = []
    by_id = np.argsort(ids, kind="stable")
    for s in range(0, len(queries), ADDED_AT_ONCE):
        part, part_ids = queries[s : s + ADDED_AT_ONCE], query_ids[s : s + ADDED_AT_ONCE]
        sums = add_slices(slices, part)
        for q, (vector, query_id) in enumerate(zip(part, part_ids, strict=True)):
            others = live
            lo, hi = np.searchsorted(ids[by_id], [query_id, query_id + 1]) if query_id < 2**63 - 1 else (0, 0)
            if hi > lo:
                others = live.copy()
                for r in by_id[lo:hi]:
                    others[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
            best = rows_of(select_top(sums[q], others, k))
            scores = values[best] @ vector
            order = np.lexsort((ids[best], -scores))[:k]
            found.append((np.full(len(order), query_id), ids[best][order], scores[order]))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def top_k(rows: DataFrame, queries: DataFrame, k: int, scale: int, *, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` best of ``rows``
    by integer inner product of quantised vectors, ties to the smaller id, itself apart.

    Vectors that are null, or that hold a null or a component that is not finite, take no part,
    nor do rows without an id; vectors meet those of their own length only. Repeated rows each
    take a place, a repeated query gets one answer. Queries should be a stated part of the rows:
    each meets each block.
    """
    def taking_part(df: DataFrame) -> DataFrame:
        found = df.select(df[id_col].cast("long").alias("id"), quantised(df[vector_col], scale).alias("v"))
        return found.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v"))

    base = taking_part(rows)
    # evenly filled blocks of each length of vector: their number follows from a count
    counts = {r["dim"]: r["count"] for r in base.groupBy("dim").count().collect()}  # one row a length
    n_blocks = F.lit(1)
    for dim, n in counts.items():
        n_blocks = F.when(F.col("dim") == dim, -(-n // block_rows)).otherwise(n_blocks)
    block = F.pmod(F.xxhash64("id", F.lit(11)), n_blocks).cast("int")
    blocks = base.withColumn("block", block)
    asked = taking_part(queries).dropDuplicates(["id"])
    n_chunks = max(1, -(-asked.count() // CHUNK_QUERIES))
    shares = -(-n_chunks // CHUNKS_A_TASK)
    chunk = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(n_chunks)).cast("int")
    chunks = asked.withColumn("chunk", chunk).groupBy("dim", "chunk").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    # every chunk goes to every block of its length
    sent = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
    index = blocks.groupBy("dim", "block").applyInArrow(_build, "dim int, block int, ids binary, vals binary, slices binary, bits int")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        b = left.to_pylist()[0]
        ids, values, slices = _unpacked(b)
        parts = [empty]
        for chunk in right["queries"].to_pylist():
            found = top_in_block(
                ids, values, slices, np.array([q["id"] for q in chunk], np.int64), np.array([q["v"] for q in chunk], np.int64), k
            )
            parts.append(pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True))))
        return pa.concat_tables(parts)

    # a slice of the queries' chunks for each task, so that a block's work is shared out
    share = F.col("chunk") % shares
    left = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    near = left.groupBy("dim", "block", "share").cogroup(sent.withColumn("share", share).groupBy("dim", "block", "share")).applyInArrow(
        search, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _build(table: pa.Table) -> pa.Table:
    """The index of one block: its ids, values and slices."""
    ids = table["id"].to_numpy()
    dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
    values = table["v"].combine_chunks().values.to_numpy().reshape(len(ids), dim).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    slices = slices_of(values) if dim else np.zeros((0, 2, -(-len(ids) // 64)), np.uint64)
    kind = np.int8 if values.size and np.abs(values).max() < 128 else np.int64
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
        "vals": pa.array([values.astype(kind).tobytes()], pa.binary()), "slices": pa.array([slices.tobytes()], pa.binary()),
        "bits": pa.array([slices.shape[1]], pa.int32()),
    })


def _unpacked(b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(b["ids"], np.int64)
    kind = np.int8 if len(b["vals"]) == len(ids) * b["dim"] else np.int64
    values = np.frombuffer(b["vals"], kind).reshape(len(ids), b["dim"]).astype(np.int64)
    return ids, values, np.frombuffer(b["slices"], np.uint64).reshape(b["dim"], b["bits"], -(-len(ids) // 64))
