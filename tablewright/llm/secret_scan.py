"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every match of a rule must hold certain trigrams; which ones follows from the rule's pattern, as a
Boolean query (Cox, "Regular expression matching with a trigram index", 2012). The index has, for
each trigram that a query names and each block of documents, the postings: the keys of documents
that hold it. Queries intersect and unite postings; only candidates are verified with the pattern.
A pattern without mandatory trigrams is tried on every document.

Spans are found by marking matches with a character and splitting there: the lengths of the
pieces give the positions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import select_texts, shuffle_partitions

MARK, OTHER_MARK = "\x01", "\x02"  # no rule's pattern tells them apart
MOST_ALTERNATIVES = 64
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


@dataclass(frozen=True)
class Rule:
    """``least``: characters that a match needs, in ``group`` of it (0: in all of it)."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i:{self.pattern})" if self.any_case else f"(?:{self.pattern})"


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Public formats of further secrets.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

# ---- from patterns to queries --------------------------------------------------------------------

Query = list[list[frozenset[str]]]  # all of: any of: all trigrams of a set


class _Reader:
    """Walks a parsed pattern. ``run``: the strings that the stretch just read can be; ``parts``:
    what is required of stretches that have ended."""

    def __init__(self):
        self.run: set[str] = {""}
        self.parts: list[set[str]] = []

    def end_run(self) -> None:
        if self.run != {""}:
            self.parts.append(self.run)
        self.run = {""}

    def extend(self, choices: set[str]) -> None:
        if len(choices) * len(self.run) > MOST_ALTERNATIVES:
            self.end_run()
        if len(choices) > MOST_ALTERNATIVES:
            return
        self.run = {a + b for a in self.run for b in choices}

    def read(self, items) -> None:
        for op, value in items:
            choices = _finite([(op, value)])
            if choices is not None:
                self.extend(choices)
                continue
            name = str(op)
            if name == "SUBPATTERN":
                self.read(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                self.end_run()
                self.read(value[2])
                self.end_run()
            else:  # classes, optional parts and all else may be anything
                self.end_run()


def _finite(items) -> set[str] | None:
    """All strings that parsed items match, if they are few."""
    found = {""}
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            more = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            more = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            more = _finite(value[3])
        elif name == "BRANCH":
            each = [_finite(v) for v in value[1]]
            more = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and value[1] == 1:
            more = _finite(value[2])
            more = None if more is None else more | {""} if value[0] == 0 else more
        elif name == "MAX_REPEAT" and value[0] == value[1] and value[0] <= 8:
            more = _finite(list(value[2]) * value[0])
        else:
            return None
        if more is None or len(found) * len(more) > MOST_ALTERNATIVES:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(rule: Rule) -> Query:
    """What every match must hold; an empty query asks for a full scan."""
    reader = _Reader()
    reader.read(re._parser.parse(rule.pattern))
    reader.end_run()
    query: Query = []
    for strings in reader.parts:
        if rule.any_case:
            strings = {s.lower() for s in strings}
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() in sets:
            continue  # a string under three characters holds no trigram
        least = [s for s in sets if not any(other < s for other in sets)]
        query.append(sorted(least, key=sorted))
    return query


def _index_terms(rules: tuple[Rule, ...]) -> list[tuple[str, bool]]:
    """Trigrams named by the rules' queries, each with whether case is folded."""
    return sorted({(t, r.any_case) for r in rules for part in trigram_query(r) for s in part for t in s})


def _term(trigram: str, any_case: bool) -> str:
    return ("i:" if any_case else "c:") + trigram


# ---- index and candidates -----------------------------------------------------------------------


def trigram_index(rows: DataFrame, rules: tuple[Rule, ...], blocks: int) -> DataFrame:
    """``block, term, postings`` for rows ``key, text``. A block's postings have as many entries
    as the block has documents at most; blocks are a hash of the key."""
    low = F.lower("text")
    held = [
        F.when(F.contains(low if any_case else F.col("text"), F.lit(t)), F.lit(_term(t, any_case)))
        for t, any_case in _index_terms(rules)
    ]
    terms = F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")
    entries = rows.select(F.pmod("key", F.lit(blocks)).alias("block"), "key", F.explode(terms).alias("term"))
    return entries.groupBy("block", "term").agg(F.collect_list("key").alias("postings"))


def _answer(query: Query, any_case: bool) -> Column:
    """Postings of the documents that satisfy a query, from a map of terms to postings."""

    def postings(t: str) -> Column:
        none = F.array().cast("array<bigint>")
        return F.coalesce(F.element_at("terms", F.lit(_term(t, any_case))), none)

    def fold(columns: list[Column], how) -> Column:
        first, *rest = columns
        for c in rest:
            first = how(first, c)
        return first

    return fold(
        [
            fold([fold([postings(t) for t in sorted(s)], F.array_intersect) for s in part], F.array_union)
            for part in query
        ],
        F.array_intersect,
    )


def candidates(rows: DataFrame, rules: tuple[Rule, ...], blocks: int) -> DataFrame:
    """``key, kinds``: the indexed rules whose queries a document satisfies."""
    indexed = [r for r in rules if trigram_query(r)]
    by_block = trigram_index(rows, rules, blocks).groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "postings"))).alias("terms")
    )
    answers = F.array(*[F.struct(F.lit(r.kind).alias("kind"), _answer(trigram_query(r), r.any_case).alias("keys")) for r in indexed])
    each = by_block.select(F.explode(answers).alias("a")).select("a.kind", F.explode("a.keys").alias("key"))
    return each.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


# ---- verification -------------------------------------------------------------------------------


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of a rule's matches that are long enough: leftmost, without overlap, code points."""
    marked = F.regexp_replace(text, rule.java, f"{MARK}$0{MARK}")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        size = F.length(F.regexp_extract(piece, rule.java, rule.group)) if rule.group else F.length(piece)
        span = F.struct(
            state["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")
        )
        more = F.when(state["inside"] & (size >= rule.least), F.concat(state["spans"], F.array(span.cast(SPAN))))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), more.otherwise(state["spans"]).alias("spans"))

    pieces = F.split(marked, MARK, -1)
    return F.when(F.contains(marked, F.lit(MARK)), F.aggregate(pieces, start, step)["spans"])


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None
) -> DataFrame:
    """``doc_id, spans`` of every row: an array of start, rank, kind and end, by start and then in
    the order of the rules. Null and empty texts have no spans; repeated rows are found each.

    Documents meet their candidates by a hash of id and text: equal rows share an answer, and a
    clash of hashes only adds candidates to verify. ``blocks`` (default: 16 for each shuffle
    partition) bounds the length of postings.
    """
    rows = select_texts(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    found = candidates(rows.select("key", "text"), rules, blocks or 16 * shuffle_partitions(docs.sparkSession))
    rows = rows.join(found, "key", "left")
    text = F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, OTHER_MARK)).otherwise(F.col("text"))
    rows = rows.select("doc_id", "kinds", text.alias("text"))
    none = F.array().cast(f"array<{SPAN}>")
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank, F.col("text"))
        if trigram_query(rule):
            spans = F.when(F.array_contains("kinds", rule.kind), spans)
        each.append(F.coalesce(spans, none))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
