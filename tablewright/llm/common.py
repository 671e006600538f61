"""Helpers shared by the operators: rows, words as bytes, rolling hashes, tokenizers."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as bytes and as a pattern of Spark.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one call of a numpy routine works on.
CHUNK_BYTES = 1 << 20
#: Bits of a bitmap of Spark's, bits for each key, and bitmaps that are broadcast at most (16 MB).
_MARK_BITS, BITS_A_KEY, MOST_MARKS = 32_768, 16, 4_096


def select_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """The two columns that an operator reads, as ``doc_id`` and ``text``; other columns and their
    names play no part. A null text becomes the empty text."""
    return df.select(
        df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), *more
    )


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``row``, all columns of a table in one, beside the columns that an operator works with: so no
    name of the table can meet one of the operator's."""
    return docs.select(F.struct(*[docs[quoted_name(c)] for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns of ``row`` as they were."""
    return rows.select("row.*")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which one may hold a third of the rows of ``left``.

    The added hash makes Spark deal out both sides anew right below the join, so that adaptive
    execution can split a hot partition; a side that an aggregation has dealt out already could
    not be split.
    """
    h = F.xxhash64(*keys)
    both = left.withColumn("_h", h).join(right.withColumn("_h", h), ["_h", *keys], how)
    return both.drop("_h")


def split_by_marks(rows: DataFrame, some: DataFrame, key: str, most: int = MOST_MARKS) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` is surely not in ``some``, and those where it may be, so that an exact join with
    ``some`` leaves the first where they are.

    Bitmaps of the keys' hashes, about ``BITS_A_KEY`` bits a key, are broadcast: at most ``most`` of 4 KB. With
    more keys than fit more rows may be in ``some``, nothing else.
    """
    n = max(1, min(most, -(-some.count() * BITS_A_KEY // _MARK_BITS)))
    h = F.xxhash64(key)
    mark, place = F.pmod(h, F.lit(n)), F.pmod(F.shiftright(h, 32), F.lit(_MARK_BITS))
    marks = some.select(mark.alias("_mark"), place.alias("_place")).groupBy("_mark").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    marked = rows.withColumn("_mark", mark).withColumn("_place", place).join(F.broadcast(marks), "_mark", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int")) == 1, F.lit(False))
    return marked.filter(~may).select(*rows.columns), marked.filter(may).select(*rows.columns)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column (null: empty)."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(ids: list, texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Slices of documents with about ``limit`` bytes; a longer document is a slice of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


# ---- words and their hashes -------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd multipliers of the two rolling hashes
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, made as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)])
                self.up, self.down = grow(np.uint64(self.base)), grow(np.uint64(self.inverse))
        return self.up[:n], self.down[:n]


class RollingHash:
    """64-bit hashes of any byte ranges of a buffer, from one cumulative sum."""

    def __init__(self, seed: int):
        self.values, self.powers = _byte_values(seed), _Powers(_BASES[seed % 2])

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers.upto(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.values[data] * up[:-1], out=sums[1:])
            return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a hash, so that each bit depends on all."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _MIX[0]
        h = (h ^ (h >> np.uint64(33))) * _MIX[1]
        return h ^ (h >> np.uint64(33))


class Words:
    """The words of some documents. ``split``: those of each document; ``doc``: which document a word is
    of; ``counts``: words of each document; ``data``: all words in one buffer, with one separator
    between words, and ``starts``/``ends`` of each word there.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        split = [(t.lower() if lower else t).split() for t in texts]  # of bytes: A-Z and ASCII space
        self.split = split
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.doc = np.repeat(np.arange(len(split)), self.counts)

    @cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(b" ".join([b" ".join(s) for s in self.split if s]), np.uint8)

    @cached_property
    def _lengths(self) -> np.ndarray:
        return np.fromiter((len(w) for s in self.split for w in s), np.int64, int(self.counts.sum()))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self._lengths + 1) - self._lengths - 1

    @cached_property
    def ends(self) -> np.ndarray:
        return self.starts + self._lengths

    def digests(self) -> np.ndarray:
        """Two independent 64-bit halves of a digest of each word, in two rows."""
        import xxhash

        joined = b"".join([xxhash.xxh3_128_digest(w) for s in self.split for w in s])
        return np.ascontiguousarray(np.frombuffer(joined, np.uint64).reshape(-1, 2).T)

    def windows(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of all windows of ``size`` words inside one document; with
        ``short``, a document with fewer words has one window of all its words."""
        if not len(self.doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first_of_doc = np.cumsum(self.counts) - self.counts
        n = np.maximum(self.counts - size + 1, 0)
        if short:
            n = np.where((self.counts > 0) & (n == 0), 1, n)
        first = np.repeat(first_of_doc - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        last_of_doc = first_of_doc + self.counts - 1
        return first, np.minimum(first + size - 1, last_of_doc[self.doc[first]])


def window_hashes(words: Words, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of windows of at most ``size`` words.

    Each is the sum of the words' digests times odd numbers drawn for their places, finished by
    mixing. The digests, unlike the bytes of a text, are not chosen by its author, so the sum has
    none of the clashes of polynomials modulo a power of two.
    """
    places = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (2, size + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    short = np.flatnonzero(last - first + 1 < size)
    found = []
    with np.errstate(over="ignore"):
        for digest, factors in zip(words.digests(), places, strict=True):
            n = max(0, len(digest) - size + 1)
            total = np.zeros(len(digest), np.uint64)
            for j in range(size):
                total[:n] += digest[j : j + n] * factors[j]
            own = total[first]
            own[short] = 0
            for j in range(size - 1):
                inside = short[first[short] + j <= last[short]]
                own[inside] += digest[first[inside] + j] * factors[j]
            found.append(mixed(own + (last - first + 1).astype(np.uint64) * factors[size]))
    return found[0], found[1]


# ---- tokenizers --------------------------------------------------------------------------------


def per_worker(key: tuple, make):
    """Keep an object as long as the Python worker lives: functions reach it by value, so their
    modules' globals do not outlive a task."""
    kept = vars(sys).setdefault("_tablewright_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget_stores() -> None:
    """Let go of what earlier stages keep in this worker, such as token stores; they are made anew where
    they are needed again."""
    vars(sys).get("_tablewright_llm", {}).clear()


#: ASCII punctuation other than the apostrophe, which starts endings such as 's.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_PROBES = ("Ab cd, ef's  (Gh)\n\té-Ü x9 <|y|> ßq.", "It's 'quoted' a.b--c ÀB;", "")


class _Store(dict):
    """A dict that makes what it lacks; one that is full starts anew, which costs time only."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordTokens:
    """Token ids of whole texts with the tokenizers library, each distinct word encoded once.

    A tokenizer that never joins across ASCII white space and drops it gives a text the ids of its
    words in turn. It also splits between letters and punctuation, so the letters inside
    punctuation are looked up apart; words of Latin letters only are given to the tokenizer's
    model in the byte form that its own rules would give them. Whether all this holds is tried on
    probes first; if not, whole texts are encoded as they are. ``ids`` returns little-endian
    integers of ``width`` bytes.
    """

    def __init__(self, path: str, keep: int = 300_000, keep_cores: int = 800_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.only_letters = re.compile(f"{_LETTERS}+").fullmatch
        self.letter_ends = re.compile(f"{_LETTERS}(.*{_LETTERS})?", re.DOTALL).fullmatch
        letters = [c for c in map(chr, range(256)) if re.fullmatch(_LETTERS, c)]
        form = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_form = {ord(c): form.pre_tokenize_str(c)[0][0] for c in letters}
        self.cores = _Store(self._core, keep_cores)
        self.words = _Store(self._word, keep)
        self.by_word = all(self._joined(p.encode()) == self._whole(p) for p in _PROBES)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _core(self, word: bytes) -> bytes:
        text = word.decode()
        if self.only_letters(text):
            return self._packed([t.id for t in self.model.tokenize(text.lower().translate(self.byte_form))])
        return self._whole(text)

    def _word(self, word: bytes) -> bytes:
        core = word.strip(_PUNCTUATION)
        if len(core) == len(word) or not core or b"<|" in word or not self.letter_ends(core.decode()):
            return self.cores[word]
        at = word.index(core)
        before, after = word[:at], word[at + len(core) :]
        return (self.cores[before] if before else b"") + self.cores[core] + (self.cores[after] if after else b"")

    def _joined(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if self.by_word:
            return [self._joined(t) for t in texts]
        return [self._whole(t.decode()) for t in texts]


def word_tokens(path: str) -> WordTokens:
    return per_worker(("tokens", path), lambda: WordTokens(path))
