"""Column functions shared by all operators."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)

# Separators that end up as hyphens in a slug (ASCII white space).
SLUG_SPACE = r" \t\n\x0B\f\r\x1c-\x1f"
SLUG_MAX_LENGTH = 160
SLUG_DEFAULT = "item"

#: Texts that are held as Python strings at once.
FOLDED_TEXTS = 256

# Units of the human-readable size.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def quoted(name: str) -> Column:
    """The column called ``name``, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so "missing" has one meaning."""
    if not any(isinstance(field.dataType, FLOATING) for field in df.schema.fields):
        return df
    return df.select(
        *[
            F.nanvl(quoted(field.name), F.lit(None).cast(field.dataType)).alias(field.name)
            if isinstance(field.dataType, FLOATING)
            else quoted(field.name)
            for field in df.schema.fields
        ]
    )


def finite_or_null(value: Column) -> Column:
    """NaN and the infinities become NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def finite_columns(df: DataFrame) -> DataFrame:
    """Apply :func:`finite_or_null` to every floating column of a result."""
    return df.select(
        *[
            finite_or_null(quoted(field.name)).alias(field.name)
            if isinstance(field.dataType, FLOATING)
            else quoted(field.name)
            for field in df.schema.fields
        ]
    )


def numeric_or_null(value: Column) -> Column:
    """A double, or NULL for text that is no number."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


@F.arrow_udf(T.StringType())
def _fold_to_ascii(values: pa.Array) -> pa.Array:
    """Texts stay in Arrow's memory; few at a time become Python strings."""
    parts = []
    for start in range(0, len(values), FOLDED_TEXTS):
        some = values.slice(start, FOLDED_TEXTS).to_pylist()
        parts.append(pa.array([None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore") for v in some], pa.binary()).cast(pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def slugify(value: Column, max_length: int = SLUG_MAX_LENGTH) -> Column:
    """URL-safe slug: ASCII, lower case, single hyphens, at most ``max_length`` characters.

    Only the Unicode decomposition needs Python (few texts at a time); the rest stays in
    the JVM.
    """
    text = F.regexp_replace(_fold_to_ascii(value), rf"[^A-Za-z0-9_{SLUG_SPACE}-]", "")
    text = F.regexp_replace(F.lower(text), rf"[-{SLUG_SPACE}]+", "-")
    text = F.regexp_replace(text, "^-+|-+$", "")
    text = F.regexp_replace(F.substring(text, 1, max_length), "-+$", "")
    return F.when(text == "", F.lit(SLUG_DEFAULT)).otherwise(text)


def same_ignoring_case(left: Column, right: Column | str) -> Column:
    """Case-insensitive equality, as used for e-mail look-ups."""
    right = right if isinstance(right, Column) else F.lit(right)
    return F.lower(left) == F.lower(right)


def content_digest(value: Column) -> Column:
    """SHA-256 of a text or binary value, in hexadecimal."""
    return F.sha2(value, 256)


def decode_label(index: Column, class_names: list[str]) -> Column:
    """Class name at ``index``; an index out of range is returned unchanged, as text."""
    position = index.cast("int")
    names = F.array(*[F.lit(name) for name in class_names])
    return F.when(
        (position >= 0) & (position < len(class_names)), F.get(names, position)
    ).otherwise(index.cast("string"))


def readable_bytes(size: Column) -> Column:
    """``0 B``, ``1.5 KB``, ``3.0 GB``: powers of 1024, one digit after the point above bytes."""
    size = size.cast("double")
    last = len(BYTE_UNITS) - 1
    text = F.format_string(f"%.1f {BYTE_UNITS[last]}", size / float(1024**last))
    for exponent in range(last - 1, 0, -1):
        text = F.when(
            size < float(1024 ** (exponent + 1)),
            F.format_string(f"%.1f {BYTE_UNITS[exponent]}", size / float(1024**exponent)),
        ).otherwise(text)
    return F.when(size < 1024.0, F.format_string(f"%.0f {BYTE_UNITS[0]}", size)).otherwise(text)


def pct(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` with four decimals, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.round(100.0 * part.cast("double") / F.nullif(whole, F.lit(0)), 4)
    )


def order_hash(columns: list[str], seed: int) -> Column:
    """A pseudo-random, engine-independent 60-bit order key of a row.

    It depends only on the values and the seed, never on partitioning, so samples, splits and
    folds are the same on any cluster and after any task retry.
    """
    parts = [F.coalesce(quoted(name).cast("string"), F.lit("\u0000")) for name in columns]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
