"""Conversation structure repair by lightest derivations.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Each row may be
kept, given the role user or assistant, or deleted, and empty rows may be inserted; the repair
wanted is the cheapest, and among equals the one whose edits' initials come first.

A state says what the rows so far end with: nothing, a system, user or assistant row. An item
``(i, state)`` is derived when the first i rows are repaired so that they end in the state; each edit
is a hyperedge from item to item with a weight (cost, audit), and weights only grow along an edge:
the cost never falls, and among equal costs a longer audit is later. So Knuth's algorithm applies:
an agenda gives out the lightest item, which is then final, and its consequences enter, until the
goal is final.

Rows are counted into elements (equal rows of one turn are one element with a count) and sorted
by ranges of (conversation, turn), so that a conversation of any length is spread over tasks. Each
task reads its rows in turn and solves chunks of at most ``CHUNK_ELEMENTS`` rows: the lightest
derivation from each state at the chunk's start to each at its end. A second agenda joins the
chunks of a conversation by edges with two tails, the item before and the chunk's own. The audits
stay inside their chunks: two items are compared by the rank of what is before and then by the
chunk's audit, which is the order of the whole audits, because an insertion always belongs to the
row after it, so that no audit of a chunk begins another.

Audits are spelled with one letter an edit, so that the roles can be read from them: K kept,
D deleted, I and J an inserted user and assistant row, R and S a row given the role of user and
assistant, and a comma after each element. J counts as I and S as R in the order; the
letters before them already fix which of the two it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

#: White space and sentence ends of the contract, and the costs of the edits.
BLANK_PATTERN = r"[^\x20\x09-\x0D]"
ENDED_PATTERN = r"[.!?][\x20\x09-\x0D]*\z"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

CHUNK_ELEMENTS = 256
STATES = "0sua"
#: What may follow a state, by the initial of the new row; a new row's initial is the next state.
FOLLOWS = {"0": "su", "s": "u", "u": "a", "a": "u"}
#: The one row that may be inserted after a state, or that a row may become.
MADE = {"0": "u", "s": "u", "u": "a", "a": "u"}
INSERTED, REROLED = {"u": "I", "a": "J"}, {"u": "R", "a": "S"}
LEGAL = ("su", "ua", "au")


class Element(NamedTuple):
    """A row and its equals. ``kind``: blank, duplicate, truncated or fine."""

    initial: str
    kind: str
    count: int


def spelled(audit: str) -> str:
    """The audit as initials of Keep, Rerole, Delete and Insert."""
    return audit.translate(str.maketrans("JS", "IR", ","))


def edges(state: str, element: Element) -> Iterator[tuple[str, int, str]]:
    """The ways to deal with one element after a state: ``(next state, cost, letters)``."""
    extra = element.count - 1  # equal rows after the first are duplicates
    if element.kind in ("blank", "duplicate"):
        yield state, DELETE * element.count, "D" * element.count + ","
        return
    rest, tail = DELETE * extra, "D" * extra + ","
    undeleted = TRUNCATED if element.kind == "truncated" else 0
    if element.initial and element.initial in FOLLOWS[state]:
        yield element.initial, undeleted + rest, "K" + tail
    made = MADE[state]
    yield made, REROLE + undeleted + rest, REROLED[made] + tail
    yield state, DELETE + rest, "D" + tail


def solve_chunk(elements: list[Element], start: str) -> dict[str, tuple[int, str]]:
    """The lightest derivation of each state after all elements, from ``start`` before them."""
    n, final = len(elements), {}
    agenda = [(0, "", 0, start)]
    ends: dict[str, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = True
        if i == n:
            ends[state] = cost, audit
            if len(ends) == len(STATES):
                break
            continue
        made = MADE[state]
        if (i, made) not in final:
            heappush(agenda, (cost + INSERT, audit + INSERTED[made], i, made))
        for following, more, letters in edges(state, elements[i]):
            if (i + 1, following) not in final:
                heappush(agenda, (cost + more, audit + letters, i + 1, following))
    return ends


#: What still has to be inserted at the end of a conversation, by the state of its last row.
CLOSING = {"0": "", "s": "IJ", "u": "J", "a": ""}


def join_chunks(moves: list[dict[tuple[str, str], tuple[int, str]]]) -> tuple[int, list[str], list[str]]:
    """The lightest derivation of a whole conversation from those of its chunks.

    Returns its cost, the audit in each chunk and the state before each chunk; the last audit
    holds what is inserted at the end. Only the links back are kept, not the audits joined.
    """
    before: dict[str, tuple[int, int]] = {"0": (0, 0)}  # state: cost and rank of the audit so far
    links: list[dict[str, tuple[str, str]]] = []
    for chunk in moves:
        agenda: list[tuple[int, int, str, str, str]] = []
        for (tail, head), (more, audit) in chunk.items():
            if tail in before:
                cost, rank = before[tail]
                heappush(agenda, (cost + more, rank, audit, head, tail))
        items, link = [], {}
        while agenda and len(link) < len(STATES):
            cost, rank, audit, head, tail = heappop(agenda)
            if head not in link:
                link[head] = tail, audit
                items.append((rank, audit, head, cost))
        before = {head: (cost, place) for place, (_, _, head, cost) in enumerate(sorted(items))}
        links.append(link)
    goal = min((cost + INSERT * len(CLOSING[s]), rank, CLOSING[s], s) for s, (cost, rank) in before.items())
    audits, starts, state = [], [], goal[3]
    for link in reversed(links):
        state, audit = link[state]
        audits.append(audit)
        starts.append(state)
    audits.reverse()
    audits[-1] += goal[2]
    return goal[0], audits, starts[::-1]


# ---- Spark ---------------------------------------------------------------------------------------

_MOVES = "array<struct<tail: string, head: string, cost: bigint, audit: string>>"
_CHUNK = (
    "part int, number bigint, conv_id {id}, turns array<{turn}>, digests array<binary>, {counts}, turns_seen bigint, "
    "first_initial string, last_initial string, first_turn {turn}, last_turn {turn}, moves " + _MOVES
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Stretches of rows of one conversation, of at most ``CHUNK_ELEMENTS`` rows."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= CHUNK_ELEMENTS):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _element(row: dict) -> Element:
    kind = "blank" if row["blank"] else "duplicate" if row["repeated"] else "truncated" if row["cut"] else "fine"
    return Element(row["initial"], kind, row["n"])


def _chunk(rows: list[dict], part: int, number: int, starts: str) -> dict:
    elements = [_element(r) for r in rows]
    counts = dict.fromkeys(_COUNTS, 0)
    for e in elements:
        counts["illegal"] += e.count - 1  # equal initials side by side
        if e.kind in ("blank", "duplicate"):
            counts[e.kind] += e.count
        else:
            counts["truncated"] += e.kind == "truncated"
            counts["duplicate"] += e.count - 1
    counts["illegal"] += sum(a.initial + b.initial not in LEGAL for a, b in zip(elements[:-1], elements[1:], strict=True))
    turns = [r["turn"] for r in rows]
    moves = [
        {"tail": s, "head": head, "cost": cost, "audit": audit}
        for s in starts
        for head, (cost, audit) in solve_chunk(elements, s).items()
    ]
    return {
        "part": part, "number": number, "conv_id": rows[0]["conv_id"], "turns": turns,
        "digests": [r["digest"] for r in rows], **counts, "turns_seen": len(set(turns) - {None}),
        "first_initial": elements[0].initial, "last_initial": elements[-1].initial,
        "first_turn": turns[0], "last_turn": turns[-1], "moves": moves,
    }


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _elements(df: DataFrame) -> DataFrame:
    """One narrow row for each (conversation, turn, role, text): its flags, its count, and whether
    an earlier turn holds the same role and text."""
    key = F.struct("conv_id", "turn", "digest").alias("key")
    counted = cut_lineage(
        df.select(
            "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"),
            (~F.col("text").rlike(BLANK_PATTERN)).alias("blank"), (~F.col("text").rlike(ENDED_PATTERN)).alias("cut"),
        )
        .groupBy(key, "initial", "blank", "cut")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pair = F.struct(F.col("key.conv_id").alias("c"), F.col("key.digest").alias("d"))
    when = F.struct(F.col("key.turn").isNotNull().alias("known"), F.col("key.turn").alias("turn"))
    firsts = counted.groupBy(pair.alias("pair")).agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("turns"))
    firsts = firsts.filter("turns > 1").select("pair", "first")  # others are their own first
    # the hash lets adaptive execution split a hot pair: it is dealt out anew right below the join
    left = counted.select("*", pair.alias("pair"), F.xxhash64("key.conv_id", "key.digest").alias("h"))
    right = firsts.select("*", F.xxhash64("pair.c", "pair.d").alias("h"))
    joined = left.join(right, ["h", "pair"], "left")
    repeated = F.col("first").isNotNull() & (F.col("first") != when)
    return joined.select("key.conv_id", "key.turn", "key.digest", "initial", "blank", "cut", "n", repeated.alias("repeated"))


def _solved_chunks(elements: DataFrame) -> DataFrame:
    types = dict(elements.dtypes)
    ddl = _CHUNK.format(id=types["conv_id"], turn=types["turn"], counts=", ".join(f"{c} bigint" for c in _COUNTS))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), [...]

        def chunks() -> Iterator[dict]:
            for number, rows in enumerate(_conversations(batches)):
                # only a task's first conversation and a further chunk may follow rows elsewhere
                inner = number == 0 or rows[0]["conv_id"] == last[0]
                yield _chunk(rows, part, number, STATES if inner else "0")
                last[0] = rows[0]["conv_id"]

        yield from _batches(chunks(), schema)

    schema = _arrow_schema(ddl)
    return elements.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(solve, ddl)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _joined_chunks(chunks: DataFrame) -> DataFrame:
    """``part, number, edits`` of each chunk, and with the first chunk of each conversation its summary."""
    id_type = dict(chunks.dtypes)["conv_id"]
    ddl = (
        f"part int, number bigint, conv_id {id_type}, edits array<string>, gaps bigint, "
        f"{', '.join(f'{c} bigint' for c in _COUNTS)}, cost bigint, audit string"
    )
    columns = ["part", "number", "conv_id", *_COUNTS, "turns_seen", "first_initial", "last_initial", "first_turn", "last_turn", "moves"]
    schema = _arrow_schema(ddl)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[list[dict]]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and row["conv_id"] != held[0]["conv_id"]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        def rows() -> Iterator[dict]:
            for held in conversations():
                cost, audits, _ = join_chunks([{(m["tail"], m["head"]): (m["cost"], m["audit"]) for m in c["moves"]} for c in held])
                totals = {c: sum(h[c] for h in held) for c in _COUNTS}
                seen = sum(h["turns_seen"] for h in held)
                for a, b in zip(held[:-1], held[1:], strict=True):
                    totals["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
                    seen -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
                first = next((h["first_known"] for h in held if h["first_known"] is not None), None)
                gaps = 0 if first is None else held[-1]["last_turn"] - first + 1 - seen
                for place, (h, audit) in enumerate(zip(held, audits, strict=True)):
                    row = {"part": h["part"], "number": h["number"], "conv_id": h["conv_id"], "edits": audit.split(",")}
                    if place == 0:
                        row |= {"gaps": gaps, **totals, "cost": cost, "audit": spelled("".join(audits))}
                    yield row

        yield from _batches(rows(), schema, 50)

    known = F.element_at(F.filter("turns", lambda t: t.isNotNull()), F.lit(1))
    first_known = F.when(F.exists("turns", lambda t: t.isNotNull()), known).alias("first_known")
    order = [F.col("conv_id").asc_nulls_first(), F.col("part").asc(), F.col("number").asc()]
    narrow = chunks.select(*columns, first_known)
    return narrow.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(join, ddl)


class Repair(NamedTuple):
    """``conversations``: one row each, with counts, cost and audit. ``rows``: the repaired rows
    ``conv_id, place, turn, role, text, edit``; ``place`` (a struct) sorts those of a conversation."""

    conversations: DataFrame
    rows: DataFrame


def repair_conversations(
    df: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> Repair:
    """Count the faults of conversations and repair them at the least cost.

    The rows of a conversation are read by turn, null turns first; rows of one turn in the order of
    a digest of role and text. Null roles and texts count as one space. A row's first fault counts:
    blank text, role and text seen earlier in the conversation, no sentence end. Blank and repeated
    rows must be deleted (4); other rows may be kept (0), deleted or given the role user or
    assistant (3), an empty row of either role may be inserted anywhere (3), and a truncated row that
    is not deleted costs 3 more. ``gaps`` counts the numbers missing between the least and the greatest
    turn, without null turns; ``illegal`` the neighbours whose initials are not su, ua or au.

    Null ids are one conversation. Repeated rows are counted before anything is moved. Texts of any
    length are moved twice and never held beside each other. Columns of other names play no part,
    whatever they are called; ``turn`` must be a whole number. An empty table gives empty tables.
    A conversation may be spread over any number of tasks, but its audit is one value and must
    fit into one.
    """
    role, text = (F.coalesce(df[c], F.lit(" ")) for c in (role_col, text_col))
    plain = df.select(df[id_col].alias("conv_id"), df[turn_col].alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    plain = plain.select("*", digest.alias("digest"))
    chunks = cut_lineage(_solved_chunks(_elements(plain)))
    joined = cut_lineage(_joined_chunks(chunks))
    summary = joined.filter(F.col("cost").isNotNull()).select("conv_id", "gaps", *_COUNTS, "cost", "audit")
    return Repair(summary, _repaired_rows(plain, chunks, joined))


def _repaired_rows(plain: DataFrame, chunks: DataFrame, joined: DataFrame) -> DataFrame:
    edited = chunks.select("part", "number", "conv_id", "turns", "digests").join(
        joined.select("part", "number", "edits"), ["part", "number"]
    )
    steps = edited.select(
        "part", "number", "conv_id", F.posexplode(F.arrays_zip("turns", "digests", "edits")).alias("at", "step")
    )
    letters = steps.select(
        "conv_id", "part", "number", "at", F.col("step.turns").alias("turn"), F.col("step.digests").alias("digest"),
        F.posexplode(F.split("step.edits", "")).alias("sub", "edit"),
    ).filter(F.col("edit").isin("I", "J", "K", "R", "S"))
    place = F.struct("part", "number", "at", "sub").alias("place")
    inserted = letters.filter(F.col("edit").isin("I", "J")).select(
        "conv_id", place, F.lit(None).cast(dict(plain.dtypes)["turn"]).alias("turn"),
        F.when(F.col("edit") == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"),
    )
    key = F.struct("conv_id", "turn", "digest").alias("key")
    texts = plain.select(key, F.col("role").alias("role"), "text").dropDuplicates(["key"])
    kept = letters.filter(F.col("edit").isin("K", "R", "S")).select(key, place, "edit").join(texts, "key")
    role = F.when(F.col("edit") == "R", "user").when(F.col("edit") == "S", "assistant").otherwise(F.col("role"))
    edit = F.when(F.col("edit") == "K", "K").otherwise("R")
    return inserted.unionByName(
        kept.select("key.conv_id", "place", "key.turn", role.alias("role"), "text", edit.alias("edit"))
    )


def rows_digest(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the lines ``role:text``, joined by line breaks.

    A checksum reads its input in order, so the rows of one conversation pass through one task; they
    are streamed, and no two batches are held at once.
    """
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string"
    schema = _arrow_schema(ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[dict]:
            current, state = None, None
            for batch in batches:
                for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if state is None or conv != current:
                        if state is not None:
                            yield {"conv_id": current, "repaired_sha256": state.hexdigest()}
                        current, state = conv, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(line.encode())
            if state is not None:
                yield {"conv_id": current, "repaired_sha256": state.hexdigest()}

        yield from _batches(results(), schema)

    lines = rows.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "place")
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest, ddl)


def damage(df: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with faults, chosen by the checksum of ``conv_id:turn``
    modulo 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it,
    4 makes it the user's. Nulls in role, text and the checksum count as one space."""
    name = F.concat(*[F.coalesce(c, F.lit(" ")) for c in (df["conv_id"].cast("string"), F.lit(":"), df["turn"].cast("string"))])
    case = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(df[c], F.lit(" ")) for c in ("role", "text"))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return df.select(
        df["conv_id"].alias("conv_id"),
        df["turn"].alias("turn"),
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"),
    ).drop("_copy")


def with_all_conversations(found: DataFrame, digests: DataFrame, df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each id of ``df``: zeros, an empty audit and the checksum of the empty text where
    no row is left."""
    ids = df.select(df[id_col].alias("conv_id")).distinct()
    key: Column = F.struct("conv_id")
    left = ids.select("conv_id", key.alias("key"))
    found = found.select(key.alias("key"), "gaps", *_COUNTS, "cost", "audit")
    digests = digests.select(key.alias("key"), "repaired_sha256")
    joined = left.join(found, "key", "left").join(digests, "key", "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
