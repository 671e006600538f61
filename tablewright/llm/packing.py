"""Hierarchical packing of documents into sequences of several lengths.

Documents are cut off whole windows of the longest context; what is left is routed to the
smallest tier (a power of two) that holds it. Each tier is packed, the longest first: a document
opens a window of its tier, the gap is filled by the longest documents of shorter tiers that fit,
and the last of them is cut to close the gap exactly. A window of a shorter tier is as long as its
tier, so it needs no padding either. Windows of one tier form step groups of even attention cost.

Each task packs its own rows in turn, with some megabytes of tokens at a time; what is left at
its end becomes windows of ever smaller powers of two, so no token of padding is needed at all
down to ``smallest``. There is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablewright.llm.common import as_bytes, chunks, select_texts, word_tokens

TIERS = (4096, 2048, 1024, 512)
HELD_TOKENS = 2_000_000
STEP_WINDOWS = 8
SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "window long, step_group long, ids binary"
)


def pack_tails(tails: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list]], list]:
    """Pack pieces ``(length, document, start)``, each shorter than the longest tier.

    Returns full windows ``(tier, pieces)`` and the pieces of the window that stayed open.
    """
    pool = sorted(tails)  # by length; the longest last
    small_first = sorted(tiers)
    windows, rest = [], []
    while pool:
        first = pool.pop()
        tier = small_first[bisect_right(small_first, first[0] - 1)]
        inside, gap = [first], tier - first[0]
        while gap and pool:
            at = bisect_right(pool, (gap, float("inf"), 0))
            if at:
                piece = pool.pop(at - 1)
            else:  # nothing fits: cut the shortest
                n, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (n - gap, doc, start + gap))
            inside.append(piece)
            gap -= piece[0]
        if gap:
            rest = inside
        else:
            windows.append((tier, inside))
    return windows, rest


def close_out(pieces: list[tuple[int, int, int]], smallest: int) -> list[tuple[int, list]]:
    """Cut what is left into windows of powers of two; a rest under ``smallest`` is one window."""
    total = sum(p[0] for p in pieces)
    windows, queue = [], list(pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        size = total if total < smallest else size
        inside, gap = [], size
        while gap:
            n, doc, start = queue.pop(0)
            if n > gap:
                queue.insert(0, (n - gap, doc, start + gap))
                n = gap
            inside.append((n, doc, start))
            gap -= n
        windows.append((size, inside))
        total -= size
    return windows


def step_groups(windows: list[tuple[int, list]], size: int) -> list[int]:
    """A group number for each window: groups of one tier, dealt in turns by attention cost, so
    that their costs are even. The last group of a tier may have fewer windows."""
    groups = [0] * len(windows)
    next_group = 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: -sum(p[0] * p[0] for p in windows[i][1]))
        n = -(-len(own) // size)
        for k, i in enumerate(own):
            turn, place = divmod(k, n)
            groups[i] = next_group + (place if turn % 2 == 0 else n - 1 - place)
        next_group += n
    return groups


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, *, tiers: tuple[int, ...] = TIERS, smallest: int = 1,
    held_tokens: int = HELD_TOKENS, step_windows: int = STEP_WINDOWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a piece: its document, place there and in its sequence, the sequence's window
    length and step group, and its token ids (little-endian unsigned 32-bit).

    A document is its text's ids and ``end_id``; a null or empty text is the end id only. Repeated
    rows are packed each, an empty table gives no rows, a null id stays null. Sequence and group
    numbers hold the task's number in their upper bits, so they follow the partitions of the input.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    longest = max(tiers)

    def pack(batches):
        tokens = word_tokens(tokenizer)
        end = int(end_id).to_bytes(tokens.width, "little")
        base = TaskContext.get().partitionId() << 32
        serial = groups = 0
        held: dict[int, tuple] = {}
        tails: list[tuple[int, int, int]] = []
        full: list[tuple[int, list]] = []
        count = key = 0

        def rows(windows):
            nonlocal serial, groups
            numbers = step_groups(windows, step_windows)
            out = [[] for _ in range(9)]
            for (size, pieces), group in zip(windows, numbers, strict=True):
                offset = 0
                for n, doc, start in pieces:
                    doc_id, ids, total = held[doc]
                    part = ids[start * tokens.width : (start + n) * tokens.width]
                    if tokens.width == 2:
                        part = np.frombuffer(part, "<u2").astype("<u4").tobytes()
                    for column, value in zip(out, (doc_id, start, n, total, base | serial, offset, size, base | (groups + group), part), strict=True):
                        column.append(value)
                    offset += n
                serial += 1
            groups += max(numbers, default=-1) + 1
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.record_batch([pa.array(c, pa.binary() if i == 8 else pa.int64()) for i, c in enumerate(out)], names)

        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                for doc_id, enc in zip(ids, tokens.ids(texts), strict=True):
                    enc += end
                    n = len(enc) // tokens.width
                    held[key] = (doc_id, enc, n)
                    full += [(longest, [(longest, key, s)]) for s in range(0, n - longest + 1, longest)]
                    if n % longest:
                        tails.append((n % longest, key, n - n % longest))
                    count += n
                    key += 1
                    if count >= held_tokens:
                        windows, tails = pack_tails(tails, tiers)
                        yield rows(full + windows)
                        held = {d: held[d] for _, d, _ in tails}
                        full, count = [], sum(t[0] for t in tails)
        windows, rest = pack_tails(tails, tiers)
        if full or windows or rest:
            yield rows(full + windows + close_out(rest, smallest))

    return select_texts(docs, id_col, text_col).mapInArrow(pack, SCHEMA)
