"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. Each model is a logistic regression on the presence of
hashed words and their beginnings and on the log-odds of the categories before it. For learning these log-odds come
from models that have not seen the row (out-of-fold), so that later models do not trust them too
much; for prediction they come from the models fitted on all learning rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import RollingHash, Words, as_bytes, chunks, mixed, per_worker

BITS = 18
PREFIX_BYTES, STEM_BYTES = 5, 4  # beginnings of longer words are features too
SAMPLE_ROWS = 3_000
FOLDS = 5
_LETTERS = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))


@dataclass
class Presence:
    """Which hashed words each text has: columns of all rows in turn, and where rows start."""

    columns: np.ndarray
    starts: np.ndarray
    n_rows: int

    @classmethod
    def of(cls, texts: list[bytes]) -> Presence:
        """In pieces of about a megabyte, as the hashes take many times a text's size."""
        parts = [cls._of(part) for _, part in chunks(texts, texts)]
        sizes = np.concatenate([[0], *[np.diff(p.starts) for p in parts]]).astype(np.int64)
        columns = np.concatenate([np.zeros(0, np.int32), *[p.columns for p in parts]])
        return cls(columns, np.cumsum(sizes), len(texts))

    @classmethod
    def _of(cls, texts: list[bytes]) -> Presence:
        words = Words([t.translate(_LETTERS) for t in texts], lower=True)
        rolling = per_worker(("words of toxicity",), lambda: RollingHash(5))
        pairs = []
        for least, most in ((1, 1 << 30), (PREFIX_BYTES + 1, PREFIX_BYTES), (STEM_BYTES + 1, STEM_BYTES)):
            own = np.flatnonzero(words.ends - words.starts >= least)
            ends = np.minimum(words.ends[own], words.starts[own] + most)
            h = rolling.ranges(words.data, words.starts[own], ends) + np.uint64(most)
            h = mixed(h) >> np.uint64(64 - BITS)
            pairs.append(words.doc[own].astype(np.int64) << BITS | h.astype(np.int64))
        pairs = np.unique(np.concatenate(pairs))
        starts = np.searchsorted(pairs, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
        return cls((pairs & ((1 << BITS) - 1)).astype(np.int32), starts, len(texts))

    def take(self, rows: np.ndarray) -> Presence:
        parts = [self.columns[self.starts[r] : self.starts[r + 1]] for r in rows]
        sizes = np.array([0, *map(len, parts)])
        return Presence(np.concatenate(parts) if parts else self.columns[:0], np.cumsum(sizes), len(rows))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each row the sum of the weights of its columns."""
        total = np.r_[0.0, np.cumsum(weights[self.columns])]
        return total[self.starts[1:]] - total[self.starts[:-1]]


@dataclass
class Linear:
    words: np.ndarray
    before: np.ndarray  # weights of earlier categories' log-odds
    bias: float

    def odds(self, x: Presence, earlier: np.ndarray) -> np.ndarray:
        return x.sums(self.words) + earlier @ self.before + self.bias


def fit_linear(x: Presence, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 80) -> Linear:
    """Weighted logistic regression by gradient steps of adapted size (Adam).

    Columns of fewer than three rows are left out; the others are scaled by the log-ratio of their
    shares in both classes (as in NB-SVM, Wang and Manning 2012), which serves small samples.
    """
    counts = np.bincount(x.columns, minlength=1 << BITS)
    used = np.flatnonzero(counts >= 3)
    number = np.full(1 << BITS, -1)
    number[used] = np.arange(len(used))
    row = np.repeat(np.arange(x.n_rows), np.diff(x.starts))
    column = number[x.columns]
    row, column = row[column >= 0], column[column >= 0]
    ones, others = np.bincount(column, y[row], len(used)), np.bincount(column, 1 - y[row], len(used))
    scale = np.log((ones + 1) / (y.sum() + 2)) - np.log((others + 1) / ((1 - y).sum() + 2))
    n, n_before = len(used), earlier.shape[1]
    theta = np.zeros(n + n_before + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = weight / weight.sum()
    for t in range(1, rounds + 1):
        odds = np.bincount(row, (scale * theta[:n])[column], x.n_rows) + earlier @ theta[n:-1] + theta[-1]
        r = share * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
        grad = np.r_[scale * np.bincount(column, r[row], n), earlier.T @ r, r.sum()] + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    words = np.zeros(1 << BITS, np.float32)
    words[used] = scale * theta[:n]
    return Linear(words, theta[n:-1], float(theta[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, one column a category."""
        found = [np.zeros((0, len(self.categories)))]
        for _, part in chunks(list(range(len(texts))), texts):
            x = Presence._of(part)
            odds = np.zeros((len(part), 0))
            for model in self.models:
                odds = np.c_[odds, np.clip(model.odds(x, odds), -8, 8)]
            found.append(1 / (1 + np.exp(-odds)))
        return np.concatenate(found)


def fit_chain(texts: list[bytes], labels: np.ndarray, weight: np.ndarray, fold: np.ndarray, categories: list[str]) -> Chain:
    """labels: rows x categories of 0 and 1; fold: a number from 0 for each row."""
    x = Presence.of(texts)
    earlier, models = np.zeros((len(texts), 0)), []
    for k in range(len(categories)):
        model = fit_linear(x, earlier, labels[:, k], weight)
        unseen = np.zeros(len(texts))
        for f in np.unique(fold):
            out = np.flatnonzero(fold == f)
            rest = np.flatnonzero(fold != f)
            if len(rest):
                part = fit_linear(x.take(rest), earlier[rest], labels[rest, k], weight[rest])
                unseen[out] = part.odds(x.take(out), earlier[out])
        shift = even_cut(unseen, labels[:, k])
        model.bias -= shift
        models.append(model)
        earlier = np.c_[earlier, np.clip(unseen - shift, -8, 8)]
    return Chain(categories, models)


def even_cut(odds: np.ndarray, y: np.ndarray, price: float = 10.0) -> float:
    """The log-odds from which a row is best called positive, by rows that the model had not
    seen: the share of positives found minus ``price`` times the share of others called so."""
    order = np.argsort(-odds, kind="stable")
    found = np.cumsum(y[order]) / max(1.0, y.sum())
    wrong = np.cumsum(1 - y[order]) / max(1.0, (1 - y).sum())
    ranked = odds[order]
    ends = np.r_[ranked[1:] < ranked[:-1], True]  # a cut is between different values
    gain = np.where(ends, found - price * wrong, -np.inf)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return 0.0
    return float((ranked[best] + ranked[min(best + 1, len(ranked) - 1)]) / 2)


def learning_sample(docs: DataFrame, labels: DataFrame, categories: list[str], *, rows: int = SAMPLE_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` rows of each value of the last category, the first in a hash order of their
    ids. Rows with a null id, text or label are
    not learnt from; an id with several rows of labels takes the largest labels."""
    known = labels.select(labels[id_col].alias("doc_id"), *[(labels[c] > 0).cast("int").alias(c) for c in categories]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    last = categories[-1]
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    counts = {r[last]: r["count"] for r in known.groupBy(last).count().collect()}  # two values
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(last) == value, min(1.0, 2 * rows / n)).otherwise(share)
    some = known.withColumn("place", place).filter(F.col("place") <= share)
    order = Window.partitionBy(last).orderBy("place", "doc_id")
    some = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).dropna()
    return texts.join(F.broadcast(some), "doc_id")  # at most 2 * rows rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], **how) -> Chain:
    """Fit on a bounded sample. Without labelled rows the chain is empty and all probabilities 0."""
    found = learning_sample(docs, labels, categories, **how).collect()
    if not found:
        return Chain(categories, [])
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    last = categories[-1]
    y = np.array([[r[c] for c in categories] for r in found], float)
    drawn = {v: float((y[:, -1] == v).sum()) for v in (0, 1)}
    weight = np.array([len(found) / 2 / drawn[r[last]] for r in found])  # classes count alike
    fold = np.array([r["n"] % FOLDS for r in found])
    return fit_chain([r["text"].encode() for r in found], y, weight, fold, categories)


def category_probabilities(docs: DataFrame, chain: Chain, text: Column) -> Column:
    """A struct column of a probability for each category; a null text has probability 0 of all."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.categories

    @F.arrow_udf(", ".join(f"`{c}` double" for c in names))
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if shipped.value.models:
                p = shipped.value.predict(as_bytes(column))
                p[np.array(column.is_null())] = 0
            else:
                p = np.zeros((len(column), len(names)))
            yield pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(names))], names)

    return predict(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], *, threshold: float = 0.5,
                      id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category in chain order, and ``flagged``: the last
    category's probability reaches ``threshold``. One row for each row of ``docs``, with or without
    labels; equal texts get equal answers."""
    chain = fit_toxicity(docs, labels, categories, rows=rows, id_col=id_col, text_col=text_col)
    scored = docs.select(docs[id_col].alias("doc_id"), category_probabilities(docs, chain, docs[text_col]).alias("p"))
    return scored.select(
        "doc_id", *[F.col("p")[c].alias(f"p_{c}") for c in categories],
        (F.col("p")[categories[-1]] >= threshold).alias("flagged"),
    )
