"""Periodic run detection: stretches of words that repeat themselves with a fixed period.

A run of period q and length L >= max(shortest, exponent * q) holds each of its words at least
``exponent`` times. A word that occurs less often inside a segment is therefore in no run of that
segment and splits it. The pieces are counted anew, since a word can be frequent in a segment and
rare in its pieces, until no piece is split further; pieces shorter than a run are dropped. All
segments of a slice of documents are split together, with sorted arrays.

What survives is scanned by lag. For a lag q the places where a word equals the word q further on
are looked at every q // 8 words only: a run covers so many of these places in a row that the few
candidates can be compared word by word. Places inside a known run whose period divides the lag are
equal for that reason alone and are left out, so a long run is compared once and not for each
multiple of its period. The work is n log n in the length of a segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tablewright.llm.common import WORD_PATTERN, as_bytes, chunks, select_texts

SHORTEST, EXPONENT = 6, 4
#: A lag is probed at this many places in each of its lengths.
PROBES = 8
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def split_by_frequency(codes: np.ndarray, docs: np.ndarray, shortest: int, times: int) -> list[tuple[int, int]]:
    """Ranges of words that may hold runs: each word of a range occurs there ``times`` times at
    least, and a range has ``shortest`` words at least. ``docs`` grows along the words."""
    places, segment = np.arange(len(codes)), docs
    width = int(codes.max()) + 1 if len(codes) else 1
    while len(places):
        key = segment * width + codes[places]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[heads, len(ordered)])
        frequent = np.empty(len(places), bool)
        frequent[order] = np.repeat(counts >= times, counts)
        kept, inside = places[frequent], segment[frequent]
        joins = (np.diff(kept) == 1) & (np.diff(inside) == 0)
        number = np.cumsum(np.r_[0, ~joins]) if len(kept) else np.zeros(0, np.int64)
        long = np.bincount(number, minlength=1)[number] >= shortest if len(kept) else np.zeros(0, bool)
        stable = len(kept) == len(places) and bool(long.all())
        places, segment = kept[long], number[long]
        if stable:
            break
    edges = np.flatnonzero(np.r_[True, (np.diff(places) != 1) | (np.diff(segment) != 0), True]) if len(places) else []
    return [(int(places[a]), int(places[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.r_[np.int8(0), same.view(np.int8), np.int8(0)]))
    return edges[::2], edges[1::2]


def scan_lags(words: np.ndarray, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of one segment of word numbers."""
    n, runs = len(words), []
    known: dict[int, list[tuple[int, int]]] = {}  # lag: places that are equal by a known run
    for lag in range(1, n // exponent + 1):
        covered = known.pop(lag, [])
        step = max(1, lag // PROBES)
        need = max(shortest, exponent * lag) - lag  # equal places in a row
        same = words[: n - lag : step] == words[lag:n:step]
        for start, end in covered:
            same[-(-start // step) : -(-end // step)] = False
        firsts, lasts = _stretches(same)
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            if b - a < need // step:
                continue
            start, end = a * step, (b - 1) * step + 1  # all places probed; now those between and around
            low, high = max(0, start - step + 1), min(n - lag, end + step - 1)
            equal = words[low:high] == words[low + lag : high + lag]
            for x, y in zip(*(e.tolist() for e in _stretches(equal)), strict=True):
                x, y = x + low, y + low
                if y - x < need or any(s <= x and y <= e for s, e in covered):
                    continue
                runs.append((x, y - x + lag, lag))
                for multiple in range(2 * lag, min(n // exponent, y + lag - x - 1) + 1, lag):
                    known.setdefault(multiple, []).append((x, y + lag - multiple))
    return runs


def runs_of_documents(
    split: list[list[bytes]], shortest: int = SHORTEST, exponent: int = EXPONENT
) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start and then period."""
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], np.int64)
    counts = np.array([len(words) for words in split], np.int64)
    first = np.cumsum(counts) - counts
    docs = np.repeat(np.arange(len(split)), counts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for start, end in split_by_frequency(codes, docs, shortest, exponent):
        doc = int(docs[start])
        offset = start - int(first[doc])
        found[doc] += [(s + offset, length, q) for s, length, q in scan_lags(codes[start:end], shortest, exponent)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only its first period."""
    if not runs:
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    gone = np.cumsum(marks)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def find_runs(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    exponent: int = EXPONENT,
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: the runs by start and then period, and
    the words joined by one space without the repetitions.

    A run is a stretch of words with smallest period q, of at least ``shortest`` words and
    ``exponent`` times q, that neither neighbour extends. Null texts, empty texts and texts of white
    space have no words, no runs and collapse to the empty text. Rows are told by nothing but
    their place, so repeated rows and null ids are rows like others; runs that tie in every respect
    cannot be, as start and period differ. Very long texts are worked on whole, with memory in
    proportion to the text. Other columns and their names play no part; an empty table gives an
    empty table. There is no shuffle.
    """
    if exponent < 2 or shortest < 1:
        raise ValueError("A run repeats at least once: exponent 2 or more, shortest 1 or more")

    @arrow_udf(f"struct<n_words: bigint, runs: {RUN}, collapsed: string>")
    def detect(text: pa.Array) -> pa.Array:
        counts, starts, lengths, periods, ends, texts = [], [], [], [], [0], []
        raw = as_bytes(text)
        for _, part in chunks(list(range(len(raw))), raw, 4 << 20):
            split = [t.split() for t in part]
            for words, runs in zip(split, runs_of_documents(split, shortest, exponent), strict=True):
                counts.append(len(words))
                starts += [r[0] for r in runs]
                lengths += [r[1] for r in runs]
                periods += [r[2] for r in runs]
                ends.append(len(starts))
                texts.append(collapse(words, runs))
        run = pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"]
        )
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), run)
        joined = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, joined], ["n_words", "runs", "collapsed"])

    found = select_texts(df, id_col, text_col).select("doc_id", detect("text").alias("_found"))
    return found.select("doc_id", "_found.n_words", "_found.runs", "_found.collapsed")


def longest_run(runs: Column | str = "runs") -> Column:
    """The run of greatest length, ties to the smallest start and then period; null without runs."""
    column = F.col(runs) if isinstance(runs, str) else runs
    return F.array_max(
        F.transform(
            column, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
        )
    )


def repeat_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: one text in ten, chosen by the checksum of its id, gets a periodic tail.

    With h the checksum and g = floor(h / 10), the n words from number g % n on are overwritten by
    repetitions of the first 1 + floor(rest / (3 + g % 8)) of them. Null ids choose nothing, texts
    without words stay as they are, null texts become empty.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = select_texts(df, id_col, text_col).select(
        "doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("_g")
    )
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    n = F.size("_words")
    start = F.when(n > 0, F.col("_g") % F.nullif(n, F.lit(0))).cast("int")
    marked = chosen.select(
        "doc_id", "text", "_g", F.when(F.col("_g").isNotNull(), words).alias("_words")
    ).select("*", start.alias("_start"))
    rest = n - F.col("_start")
    period = (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int")
    block = F.slice("_words", F.col("_start") + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / period).cast("int"))), 1, rest)
    text = F.array_join(F.concat(F.slice("_words", 1, F.col("_start")), tail), " ")
    return marked.select("doc_id", F.when(F.col("_start").isNotNull(), text).otherwise(F.col("text")).alias("text"))
