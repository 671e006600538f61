"""Language identification with string kernels.

Two texts are as similar as the sets of byte n-grams that occur in them: for each length n from 1
to 3 the number of shared n-grams over the square root of the product of both set sizes, summed
over the lengths (a blended spectrum of presence). Landmark texts span the feature space (Nyström),
and one ridge regression per language against the rest is fitted on a bounded sample. N-grams
that no landmark has are left out of all sets.

A text's kernels with all landmarks are matrix products of its presence rows; since the ridge
weights follow linearly, both factors are folded into one matrix for each length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import as_bytes, chunks, forget_stores, packed, unpacked

UNKNOWN = "und"
LENGTHS = (1, 2, 3)
_LETTER = re.compile(rb"[A-Za-z]")


def _folded(text: bytes) -> bytes:
    """ASCII letters in lower case, other ASCII as space; further bytes as they are."""
    return text.lower().translate(bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)))


@dataclass
class Spectrum:
    """The n-grams of the landmarks: ``symbol`` numbers their bytes (0: any other), ``columns``
    has for each length a table from code to column (0: not among them)."""

    symbol: np.ndarray
    columns: list[np.ndarray]
    widths: list[int]

    @classmethod
    def of(cls, texts: list[bytes]) -> Spectrum:
        data = np.frombuffer(b"".join(map(_folded, texts)), np.uint8)
        symbol = np.zeros(256, np.int64)
        used = np.unique(data)
        symbol[used] = np.arange(1, len(used) + 1)
        made = cls(symbol, [], [])
        base = len(used) + 1
        for n in LENGTHS:
            seen = np.zeros(base**n, bool)
            for text in texts:
                seen[made.codes(np.frombuffer(_folded(text), np.uint8), n)[0]] = True
            table = np.zeros(base**n, np.int32)
            table[seen] = np.arange(1, int(seen.sum()) + 1)
            made.columns.append(table)
            made.widths.append(int(seen.sum()) + 1)
        return made

    def codes(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams without an unnumbered byte, and where they start."""
        s = self.symbol[data]
        if len(s) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base, code, good = int(self.symbol.max()) + 1, 0, True
        for i in range(n):
            part = s[i : len(s) - n + 1 + i]
            code, good = code * base + part, good & (part > 0)
        at = np.flatnonzero(good)
        return code[at], at

    def presence(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each length the rows of presence, over the square root of their number."""
        folded = [_folded(t) for t in texts]
        data = np.frombuffer(b"\x00".join(folded), np.uint8)
        lengths = np.fromiter(map(len, folded), np.int64, len(folded)) + 1
        row = np.repeat(np.arange(len(folded)), lengths)
        found = []
        for n, table, width in zip(LENGTHS, self.columns, self.widths, strict=True):
            code, at = self.codes(data, n)
            rows = np.zeros(len(folded) * width, np.float32)
            rows[row[at] * width + table[code]] = 1
            rows = rows.reshape(len(folded), width)
            rows[:, 0] = 0
            found.append(rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)))
        return found


@dataclass
class LanguageModel:
    labels: list[str]
    spectrum: Spectrum | None
    weights: list[np.ndarray]  # for each length: columns x labels

    def margins(self, texts: list[bytes]) -> np.ndarray:
        return sum(p @ w for p, w in zip(self.spectrum.presence(texts), self.weights, strict=True))

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """A label and a score from 0 to 1 for each text; ``und`` and 0 without letters."""
        found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        readable = [i for i, t in enumerate(texts) if has_letters(t)]
        if not self.labels or not readable:
            return found, scores
        start = 0
        for _, part in chunks(readable, [texts[i] for i in readable]):
            margins = self.margins(part)
            best = margins.argmax(1)
            grown = np.exp(4 * (margins - margins.max(1, keepdims=True)))
            sure = 1 / grown.sum(1)
            for k, i in enumerate(readable[start : start + len(part)]):
                found[i], scores[i] = self.labels[best[k]], float(min(1.0, sure[k]))
            start += len(part)
        return found, scores


def has_letters(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode())


def fit_texts(texts: list[bytes], labels: list[str], landmarks: int = 60, ridge: float = 1.0) -> LanguageModel:
    """Fit on given texts; the first ``landmarks`` of each label are landmarks."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], None, [])
    chosen = [i for name in names for i in [k for k, x in enumerate(labels) if x == name][:landmarks]]
    spectrum = Spectrum.of([texts[i] for i in chosen])
    own = [spectrum.presence([t for t in texts[s : s + 200]]) for s in range(0, len(texts), 200)]
    rows = [np.concatenate([o[k] for o in own]) for k in range(len(LENGTHS))]
    marks = [r[chosen] for r in rows]
    kernel = sum(r @ m.T for r, m in zip(rows, marks, strict=True)).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-5 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: features are kernels times this
    features = np.c_[kernel @ root, np.ones(len(texts))]
    target = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    gram = features.T @ features + ridge * len(texts) * np.eye(features.shape[1]) / 100
    solved = np.linalg.solve(gram, features.T @ target)
    weights = [(m.T @ (root @ solved[:-1])).astype(np.float32) for m in marks]
    for w in weights:
        w[0] = 0
    return LanguageModel(names, spectrum, weights)


def fit_language_model(docs: DataFrame, *, per_language: int = 400, landmarks: int = 60, id_col: str = "doc_id",
                       text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Fit on at most ``per_language`` labelled rows of each language, the first in a hash order of
    their ids. Rows with a null id, text or label are not learnt from; without any, the model
    answers ``und``. The languages themselves are counted on the driver: one row a label."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[label_col].alias("label"))
    rows = rows.dropna().filter(F.length(F.trim("text")) > 0)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return LanguageModel([], None, [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * per_language / n))])
    some = rows.withColumn("place", place).filter(F.col("place") <= share[F.col("label")])
    order = Window.partitionBy("label").orderBy("place", "doc_id", "text")
    first = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    kept = sorted(first.select("label", "n", "text").collect())
    return fit_texts([r.text.encode() for r in kept], [r.label for r in kept], landmarks)


def predicted(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """A struct column ``lang, score`` for whole texts (null: ``und``, 0)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_stores()
        for column in columns:
            langs, scores = shipped.value.predict(as_bytes(column))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict(text)


def _with_letters(text: Column) -> Column:
    """Whether a text has letters by the rule of the model (null: no)."""

    @F.arrow_udf("boolean")
    def check(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([has_letters(t) for t in as_bytes(column)], pa.bool_())

    return check(text)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: CRC-32 of the id as text leaves 2 when divided by 4 (null: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learnt from rows that are not held out.

    Null texts and texts without letters get ``und`` and 0; equal texts get equal answers.
    """
    model = fit_language_model(docs.filter(~is_held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = rows.select("doc_id", is_held_out().alias("held_out"), predicted(docs, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``docs`` without rows of no language: null texts and texts without letters.

    Without any label to learn from (all null, or only on held-out rows) no text with letters can be
    told to be of no language, so all of these stay. Repeated rows and null ids are rows like others,
    an empty table stays empty, and columns may have any names.
    """
    model = fit_language_model(docs.filter(~is_held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col)
    if not model.labels:
        return docs.filter(_with_letters(docs[text_col]))
    answered = packed(docs, predicted(docs, model, docs[text_col]).alias("answer"))
    return unpacked(answered.filter(F.col("answer.lang") != UNKNOWN))
