"""SentencePiece encoding and decoding of merge-type vocabularies.

A text is given its leading mark, its spaces become marks, and it is cut into characters. An agenda
holds all adjacent pairs of symbols that the vocabulary knows, the best score first and then the
leftmost; the pair on top is merged and its two new neighbours enter, until the agenda is empty.
A symbol outside the vocabulary falls back to the pieces of its bytes.

A pair never joins across a place that no piece of the vocabulary spans. Texts are therefore cut at
such places first: before a mark that follows another character, and around characters that occur in
no piece of several characters. Each distinct part meets the agenda once in a worker, however often
it occurs. The parts that are new in an Arrow batch are also encoded with the sentencepiece library,
all in one call, and ``agrees`` tells for each text whether the library gave the same ids for all.
"""

from __future__ import annotations

import codecs
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tablewright.llm.common import per_worker, select_texts

MARK = "▁"
#: Half of the distinct parts kept by a worker, and the longest part worth keeping.
KEPT_PARTS = 200_000
KEPT_LENGTH = 64


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class PieceVocabulary:
    """The pieces, scores and kinds of a model file, with encoding by agenda and decoding."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        codecs.register_error("tablewright_each_byte", _each_byte)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        rules, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = rules.add_dummy_prefix and rules.escape_whitespaces
        if (
            proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE
            or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not plain
            or proto.trainer_spec.treat_whitespace_as_suffix
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
        ):
            raise ValueError(f"{path}: only merge-type models with plain normalisation are supported")
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.surfaces: list[bytes] = []
        self.silent: set[int] = set()
        self.unknown = 0
        for number, p in enumerate(proto.pieces):
            surface = p.piece.replace(MARK, " ").encode()
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = number, p.score
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], surface = number, bytes([value])
            elif p.type == kinds.UNKNOWN:
                self.unknown, surface = number, proto.trainer_spec.unk_surface.encode()
            else:
                surface = b""
                self.silent.add(number)
            self.surfaces.append(surface)
        self.leads = {i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL and p.piece.startswith(MARK)}
        self.cut = self._cutter()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def _cutter(self):
        """A function that cuts a marked text at places that no piece spans.

        Characters that stand side by side in a piece are of one class; two neighbours of different
        classes never join. Marks stand only in front of pieces and belong to what follows.
        """
        long_pieces = [p for p in self.ids if len(p) > 1]
        self.whole = any(MARK in p.lstrip(MARK) or "\n" in p for p in long_pieces)
        if self.whole:
            return lambda text: [text]  # no safe place
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for piece in long_pieces:
            inner = piece.lstrip(MARK)
            for x, y in zip(inner[:1] + inner, inner, strict=False):
                root[find(x)] = find(y)
        classes: dict[str, list[str]] = {}
        for c in sorted(root):
            classes.setdefault(find(c), []).append(re.escape(c))
        runs = [f"[{''.join(chars)}]+" for chars in sorted(classes.values(), key=len, reverse=True)]
        return re.compile(f"{MARK}*(?:{'|'.join([*runs, '(?!)'])})|{MARK}+|.", re.DOTALL).findall

    def merge(self, text: str) -> list[str]:
        """The symbols that are left when no adjacent pair makes a piece; ``text`` has its marks."""
        symbols: list[str] = list(text)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        scores = self.scores
        agenda = []
        for i in range(len(symbols) - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, pair))
        heapify(agenda)
        end = len(symbols)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            if right == end or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue  # one of the two was merged meanwhile
            symbols[left], symbols[right] = pair, ""
            after[left] = follower = after[right]
            if follower < end:
                before[follower] = left
                joined = pair + symbols[follower]
                if joined in scores:
                    heappush(agenda, (-scores[joined], left, joined))
            leader = before[left]
            if leader >= 0:
                joined = symbols[leader] + pair
                if joined in scores:
                    heappush(agenda, (-scores[joined], leader, joined))
        return [s for s in symbols if s]

    def merged_ids(self, text: str) -> list[int]:
        ids: list[int] = []
        for symbol in self.merge(text):
            number = self.ids.get(symbol)
            if number is not None:
                ids.append(number)
            elif self.byte_ids:
                ids.extend(map(self.byte_ids.__getitem__, symbol.encode()))
            elif not ids or ids[-1] != self.unknown:  # the library joins neighbouring unknowns
                ids.append(self.unknown)
        return ids

    def library_ids(self, parts: list[str]) -> list[list[int]]:
        """What the library gives for parts of a marked text. It adds a mark of its own, so a part
        is encoded behind a line break, which joins with nothing, and the ids in front are dropped."""
        if self.whole:
            return self.library.encode([p[1:] for p in parts], num_threads=1)
        lead = len(self.library.encode("\n"))
        return [ids[lead:] for ids in self.library.encode(["\n" + p for p in parts], num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of whole texts as 32-bit integers, and whether the library agrees on all parts."""
        if len(self.known) >= KEPT_PARTS:  # what is still in use comes back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        cuts = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        used = {part for parts in cuts for part in parts if part not in known}
        new = [part for part in used if part not in older]
        known.update((part, older[part]) for part in used.difference(new))
        long = []
        for part, expected in zip(new, self.library_ids(new) if new else [], strict=True):
            ids = self.merged_ids(part)
            known[part] = array("i", ids).tobytes()
            if len(part) > KEPT_LENGTH:
                long.append(part)
            if ids != expected:
                self.differing.add(part)
        encoded = [b"".join(map(known.__getitem__, parts)) for parts in cuts]
        for part in long:
            del known[part]
        if not self.differing:
            return encoded, [True] * len(cuts)
        return encoded, [self.differing.isdisjoint(parts) for parts in cuts]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: marks become spaces, the leading one goes, bytes that make no
        character become U+FFFD, one for each byte."""
        first = next((i for i, number in enumerate(ids) if number not in self.silent), None)
        if first is None:
            return ""
        runs, start = [], first
        if not self.silent.isdisjoint(ids):  # bytes do not join across pieces without a surface
            for i, number in enumerate(ids):
                if number in self.silent:
                    runs.append(ids[start:i])
                    start = i + 1
        raw = [b"".join(map(self.surfaces.__getitem__, run)) for run in [*runs, ids[start:]]]
        text = "".join([r.decode("utf-8", "tablewright_each_byte") for r in raw])
        return text[1:] if ids[first] in self.leads else text


def vocabulary(path: str) -> PieceVocabulary:
    return per_worker(("pieces", path), lambda: PieceVocabulary(path))


#: Bytes of text encoded together.
SLICE_BYTES = 2 << 20


def slices(column: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_BYTES``, at least one; a longer row is a range of its own."""
    sizes = np.array(pc.fill_null(pc.binary_length(column), 0))
    ranges, start, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            ranges.append((start, i))
            start, held = i, 0
        held += size
    return [*ranges, (start, len(column))]


def _joined(lists: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit integers from their bytes."""
    ends = np.cumsum([0, *(len(x) // 4 for x in lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(lists), np.int32)))


def encode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids: ``doc_id, ids array<int>, decoded string, agrees boolean``,
    one row for each row.

    Null and empty texts have no ids, decode to the empty text and agree. Bytes that are not UTF-8
    count as U+FFFD. Repeated rows, null ids and other columns, whatever their names, play no part;
    an empty table gives an empty table. Very long texts are encoded whole, with memory in proportion
    to the text; beside it a task holds ``SLICE_BYTES`` of text and what the worker keeps of parts.
    There is no shuffle. ``path`` must be readable on all executors.
    """

    @arrow_udf("struct<ids: array<int>, decoded: string, agrees: boolean>")
    def encode(text: pa.Array) -> pa.Array:
        words = vocabulary(path)
        raw = text.cast(pa.binary())
        parts = []
        for start, end in slices(raw):
            texts = [(t or b"").decode("utf-8", "replace") for t in raw.slice(start, end - start).to_pylist()]
            ids, same = words.encode(texts)
            back = [words.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
            parts.append(
                pa.StructArray.from_arrays(
                    [_joined(ids), pa.array(back, pa.string()), pa.array(same, pa.bool_())], ["ids", "decoded", "agrees"]
                )
            )
        return pa.concat_arrays(parts)

    coded = select_texts(df, id_col, text_col).select("doc_id", encode("text").alias("_coded"))
    return coded.select("doc_id", "_coded.ids", "_coded.decoded", "_coded.agrees")


def decode_pieces(ids: Column | str, path: str) -> Column:
    """Texts of an array of ids; null and empty arrays give the empty text."""

    @arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        words = vocabulary(path)
        return pa.array([words.decode(x.as_py() or []) for x in column], pa.string())

    return decode(F.col(ids) if isinstance(ids, str) else ids)
