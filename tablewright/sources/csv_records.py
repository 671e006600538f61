"""CSV records of large files, also with line breaks inside quotes, read by many tasks.

Lines are read in splits of the files. Whether a split starts inside quotes depends on all that is
before it, so a first pass tells for both cases how the split ends, and which text at its ends belongs
to records that other splits share. These few values are chained along each file; then every split is
read once more with its true start, and whole records leave it as they are. Records that cross splits
are put together from their ends. Nothing but one row a split is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.errors import DataLoadError
from tablewright.session import cut_lineage

_ENDS = "file string, start bigint, ends_out boolean, ends_in boolean, tail_out string, head_in string, tail_in string, starts_out boolean, starts_in boolean"


def inside_after(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether a quoted cell is open after a line, if one was (not) open before it.

    A quote opens a cell at its start only; inside, two quotes are one, and a quote closes the cell
    before a separator or the end of the line. Any other quote is part of the text.
    """
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            following = line[at + 1 : at + 2]
            if following == '"':
                at += 2
            elif following == separator:
                inside, at = False, at + 2
            elif at + 1 == n or line[at + 1 :] == "\r":
                return False
            else:
                at += 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
        else:
            at = line.find(separator, at)
            if at < 0:
                return False
            at += 1


class _Split:
    """The lines of one split, read as if it started outside or inside quotes."""

    def __init__(self, inside: bool, separator: str):
        self.inside, self.separator = inside, separator
        self.held: list[str] = []
        self.head: str | None = None  # what belongs to a record of an earlier split
        self.in_head = inside
        self.records = 0

    def add(self, line: str, quoted: bool) -> str | None:
        """Take a line; return the record that ends with it, if one does that started here."""
        self.held.append(line)
        if quoted:
            self.inside = inside_after(line, self.inside, self.separator)
        if self.inside:
            return None
        text = "\n".join(self.held) if len(self.held) > 1 else line
        self.held.clear()
        if self.in_head:
            self.head, self.in_head = text, False
            return None
        self.records += 1
        return text

    def open(self) -> tuple[str | None, str | None]:
        """Head and tail: the ends that belong to records which other splits share."""
        rest = "\n".join(self.held) if self.held else None
        return (rest, None) if self.in_head else (self.head, rest)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _place(file: str, start: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{start}:{file}".encode(), digest_size=8).digest(), "little", signed=True)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Stretches of lines of one split; a split's lines stand together and in order."""
    for batch in batches:
        values, files, starts = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(values):
            end, place = at + 1, (files[at], starts[at])
            while end < len(values) and (files[end], starts[end]) == place:
                end += 1
            yield place, values[at:end]
            at = end


def _ends(separator: str):
    """For each split how it ends for both starts, and its shared ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in _ENDS.split(", "))])

        def row(place, outer, inner):
            (_, tail_out), (head_in, tail_in) = outer.open(), inner.open()
            values = (*place, outer.inside, inner.inside, tail_out, head_in, tail_in, outer.records > 0, inner.records > 0)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        place = outer = inner = None
        for here, lines in _by_split(batches):
            if here != place:
                if place is not None:
                    yield row(place, outer, inner)
                place, outer, inner = here, _Split(False, separator), _Split(True, separator)
            for line in lines:
                quoted = '"' in line
                outer.add(line, quoted)
                inner.add(line, quoted)
        if place is not None:
            yield row(place, outer, inner)

    return scan


def _whole(places: np.ndarray, states: np.ndarray, separator: str):
    """The records that lie inside one split, and whether each is the first of its file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = split = None
        for here, lines in _by_split(batches):
            if here != place:
                key = _place(*here)
                at = int(np.searchsorted(places, key))
                if at == len(places) or places[at] != key:
                    raise RuntimeError(f"{here[0]} was split otherwise before: read it again")
                place, split = here, _Split(bool(states[at]), separator)
            found, first = [], []
            for line in lines:
                number = split.records
                record = split.add(line, '"' in line)
                if record is not None:
                    found.append(record)
                    first.append(number == 0 and here[1] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(first, pa.bool_())], ["record", "first"])

    return scan


def csv_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``record, first``: the records of CSV files as text, and whether one is the first of its file.

    The files must not change between the two passes. An open quote at the end of a file ends with it.
    Lines end in a line feed, with or without a carriage return before it; empty lines are no records.
    """
    ends = cut_lineage(_lines(spark, path).mapInArrow(_ends(separator), _ENDS))
    # the state before each split: a chain of two-way choices along the file
    chain = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "ends_out", "ends_in"))).alias("splits"))
    step = lambda acc, s: F.struct(
        F.when(acc["inside"], s["ends_in"]).otherwise(s["ends_out"]).alias("inside"),
        F.concat(acc["found"], F.array(F.struct(s["start"].alias("start"), acc["inside"].alias("inside")))).alias("found"),
    )
    none = F.array().cast("array<struct<start: bigint, inside: boolean>>")
    found = F.aggregate("splits", F.struct(F.lit(False).alias("inside"), none.alias("found")), step)["found"]
    states = chain.select("file", F.inline(found))
    keyed = sorted((_place(r["file"], r["start"]), r["inside"]) for r in states.toLocalIterator())  # a row a split
    places, flags = np.array([k for k, _ in keyed], np.int64), np.array([s for _, s in keyed], np.uint8)
    if len(np.unique(places)) != len(places):
        raise DataLoadError(f"Could not tell the splits of {path!r} apart.")
    whole = _lines(spark, path).mapInArrow(_whole(places, flags, separator), "record string, first boolean")
    return whole.unionByName(_shared(ends.join(states, ["file", "start"]))).filter(F.trim(F.col("record")) != "")


def _shared(ends: DataFrame) -> DataFrame:
    """Records that cross splits: the tail of one split and the heads of those after it."""
    head = F.when(F.col("inside"), F.col("head_in"))
    tail = F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out"))
    began = F.when(F.col("inside"), F.col("starts_in")).otherwise(F.col("starts_out"))
    parts = ends.select(
        "file", "start", (began | F.col("inside")).alias("later"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), head.alias("text")), F.struct(F.lit(1).alias("side"), tail.alias("text")))).alias("p"),
    ).filter("p.text is not null")
    order = Window.partitionBy("file").orderBy("start", "p.side").rowsBetween(Window.unboundedPreceding, 0)
    owned = parts.withColumn("owner", F.last(F.when(F.col("p.side") == 1, F.col("start")), True).over(order))
    joined = owned.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "p.side", "p.text"))).alias("parts"),
        F.max_by("later", F.when(F.col("p.side") == 1, 1)).alias("later"),
    )
    return joined.select(
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("record"),
        ((F.col("owner") == 0) & ~F.col("later")).alias("first"),
    )
