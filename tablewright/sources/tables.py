"""Readers, and versioned storage of tables."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import DataLoadError
from tablewright.functions.scalars import quoted
from tablewright.sources.csv_records import csv_records

# File types by extension.
EXTENSIONS = {".csv": "csv", ".txt": "csv", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet"}


def file_type_of(name: Column) -> Column:
    """:func:`detect_file_type` for a column of names; NULL where the extension is not known."""
    lowered = F.rtrim(F.lower(name), F.lit("/"))
    kind = F.lit(None).cast("string")
    for extension, value in EXTENSIONS.items():
        kind = F.when(F.endswith(lowered, F.lit(extension)), value).otherwise(kind)
    return kind


def detect_file_type(name: str) -> str:
    """csv, excel or parquet, by the extension, whatever its case."""
    lowered = name.lower().rstrip("/")
    for extension, kind in EXTENSIONS.items():
        if lowered.endswith(extension):
            return kind
    raise DataLoadError(f"Unsupported file extension for {name!r}; expected {sorted(EXTENSIONS)}.")


#: Texts that stand for a missing cell.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, *,
    multiline: bool = True, missing: tuple[str, ...] = MISSING_MARKERS,
) -> DataFrame:
    """CSV with a header. Types are inferred (one more pass) unless a schema is given.

    Large files are split over tasks either way. With ``multiline`` line breaks may stand inside
    quotes, which takes one more pass over the lines; without, each line is a record. ``missing`` are
    the texts that stand for NULL. Dates stay text, as a plain CSV reader leaves them.
    """
    wanted = None
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if multiline:
        texts = _record_texts(spark, path, wanted.fieldNames() if wanted is not None else None)
    else:
        reader = spark.read.option("header", True).option("escape", '"')
        if wanted is not None:
            reader = reader.schema(_text_schema(wanted.fieldNames()))
        texts = reader.csv(path)
    cells = [
        F.when(~quoted(c).isin(*missing), quoted(c)).alias(c) if missing else quoted(c) for c in texts.columns
    ]
    texts = texts.select(*cells)
    kinds = [f.dataType for f in wanted] if wanted is not None else _inferred_types(texts)
    return texts.select(*[
        F.trim(quoted(c)).try_cast(kind).alias(c) if not isinstance(kind, T.StringType) else quoted(c)
        for c, kind in zip(texts.columns, kinds, strict=True)
    ])


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


#: One record a value: quotes are doubled, and nothing inside them is changed. An empty cell is NULL
#: without quotes and an empty text with them, so NULL goes by a text that no file holds.
_RECORD_OPTIONS = {"escape": '"', "multiLine": "true", "nullValue": "\x00\x01null"}


def _record_texts(spark: SparkSession, path: str, names: list[str] | None) -> DataFrame:
    """The cells of all records but the headers, as texts."""
    records = csv_records(spark, path)
    if names is None:
        # the schema function of Spark tells the number of cells; their texts are the names
        header = records.filter("first").agg(F.min("record").alias("record")).first()["record"]
        if header is None:
            return spark.createDataFrame([], T.StructType([]))
        line = spark.createDataFrame([(header.lstrip("\ufeff").rstrip("\r"),)], "record string")
        width = len(T._parse_datatype_string(line.select(F.schema_of_csv(F.lit(line.first()["record"]), _RECORD_OPTIONS)).first()[0]))
        cells = line.select(F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), _RECORD_OPTIONS).alias("r")).first()["r"]
        names = _distinct_names(list(cells))
    schema = _text_schema([f"c{i}" for i in range(len(names))]).simpleString()[len("struct<") : -1].replace(":", " ")
    rows = records.filter("not first").select(F.from_csv(F.regexp_replace("record", r"\r\z", ""), schema, _RECORD_OPTIONS).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])


def _distinct_names(cells: list[str | None]) -> list[str]:
    """Names of columns: empty ones by their place, repeated ones with it."""
    names = [c if c else f"_c{i}" for i, c in enumerate(cells)]
    twice = {n for n in names if [m.lower() for m in names].count(n.lower()) > 1}
    return [f"{n}{i}" if n in twice else n for i, n in enumerate(names)]


def _inferred_types(texts: DataFrame) -> list[T.DataType]:
    """Whole number, number, boolean or text for each text column; one aggregate over all."""
    checks = []
    for i, c in enumerate(texts.columns):
        value = quoted(c)
        whole = F.when(value.rlike(WHOLE), F.trim(value).try_cast("bigint"))
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count(whole).alias(f"w{i}"),
            F.max(F.abs(whole.cast("double"))).alias(f"m{i}"),
            F.count_if(value.rlike(NUMBER)).alias(f"d{i}"),
            F.count_if(F.lower(F.trim(value)).isin("true", "false")).alias(f"b{i}"),
        ]
    row = texts.agg(*checks).first()

    def kind(i: int) -> T.DataType:
        n = row[f"n{i}"]
        if not n:
            return T.StringType()
        if row[f"w{i}"] == n:
            return T.IntegerType() if row[f"m{i}"] < 2**31 else T.LongType()
        if row[f"d{i}"] == n:
            return T.DoubleType()
        return T.BooleanType() if row[f"b{i}"] == n else T.StringType()

    return [kind(i) for i in range(len(texts.columns))]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files."""
    return spark.read.parquet(path)


def read_excel(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """First sheets of Excel files, one task per file; needs the ``openpyxl`` library."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as exc:
        raise DataLoadError("Reading Excel files needs the openpyxl library.") from exc
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = schema.fieldNames()

    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.read_excel(io.BytesIO(content), engine="openpyxl")[names]

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(sheets, schema)


def check_not_empty(df: DataFrame) -> DataFrame:
    """Raise for a table without columns or rows."""
    if not df.columns:
        raise DataLoadError("The file contains no columns.")
    if df.isEmpty():
        raise DataLoadError("The file contains no rows.")
    return df


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """Read a file or folder by its extension; empty tables are errors. ``options`` are those of
    :func:`read_csv` and stand for CSV only."""
    kind = detect_file_type(path)
    try:
        if kind == "csv":
            df = read_csv(spark, path, schema, **options)
        elif kind == "excel":
            if schema is None:
                raise DataLoadError("Reading Excel files needs a schema.")
            df = read_excel(spark, path, schema)
        else:
            df = read_parquet(spark, path)
        return check_not_empty(df)
    except DataLoadError:
        raise
    except Exception as exc:
        raise DataLoadError(f"Could not read {path!r} as {kind}: {exc}") from exc


def content_checksum(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, checksum)``: a digest of all rows that ignores their order.

    Every row gives two 60-bit hashes; their sums are independent of order and partitioning.
    A NULL is told apart from an empty text, and the bounds of neighbouring values are kept.
    """
    parts = []
    for name in df.columns:
        text = quoted(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    digest = F.md5(F.concat_ws("|", *parts))
    first = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    second = F.conv(F.substring(digest, 16, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sha2(
            F.concat_ws(
                "|",
                F.count(F.lit(1)).cast("string"),
                F.coalesce(F.sum(first), F.lit(0)).cast("decimal(38,0)").cast("string"),
                F.coalesce(F.sum(second), F.lit(0)).cast("decimal(38,0)").cast("string"),
            ),
            256,
        ).alias("checksum"),
    )


class NumberedFolders:
    """Folders ``name=1``, ``name=2``, … of which each becomes visible whole, and is written by one writer.

    A writer prepares its folder under a name of its own, claims the next number by creating a file
    that must not exist yet, and renames the folder to it. A writer that dies leaves a number unused or
    a folder that nobody reads, never half a version.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def _hadoop(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[str]:
        folder, files = self._hadoop(path)
        if not files.exists(folder):
            return []
        return [status.getPath().getName() for status in files.listStatus(folder)]

    def numbers(self) -> list[int]:
        """Existing numbers, ascending (a directory listing, no scan)."""
        start = f"{self.name}="
        names = [n.removeprefix(start) for n in self._listed(self.path) if n.startswith(start)]
        return sorted(int(n) for n in names if n.isdigit())

    def folder(self, number: int) -> str:
        return f"{self.path}/{self.name}={number}"

    def _claim(self, number: int) -> bool:
        """Create the number's claim; False if another writer has it."""
        from py4j.protocol import Py4JJavaError

        place, files = self._hadoop(f"{self.path}/_claims/{self.name}={number}")
        try:
            if files.getUri().getScheme() == "file":  # exclusive creation, which Hadoop's local files lack
                files.mkdirs(place.getParent())
                java = self.spark._jvm.java
                none = self.spark.sparkContext._gateway.new_array(java.nio.file.attribute.FileAttribute, 0)
                java.nio.file.Files.createFile(java.nio.file.Path.of(files.makeQualified(place).toUri()), none)
            else:
                files.create(place, False).close()
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def add(self, prepare: Callable[[str], None], finish: Callable[[str, int], None] | None = None) -> int:
        """Let ``prepare`` fill a folder, and ``finish`` complete it once its number is known."""
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        prepare(staged)
        claimed = [int(n.split("=")[1]) for n in self._listed(f"{self.path}/_claims") if n.startswith(f"{self.name}=")]
        number = max([0, *self.numbers(), *claimed]) + 1
        while not self._claim(number):
            number += 1
        if finish:
            finish(staged, number)
        source, files = self._hadoop(staged)
        if not files.rename(source, self._hadoop(self.folder(number))[0]):
            raise DataLoadError(f"Could not make {self.folder(number)} visible.")
        return number


class VersionedTable:
    """A table kept as immutable snapshots ``version=N/`` below a folder, each with its record."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folders = NumberedFolders(spark, path, "version")

    def versions(self) -> list[int]:
        """Existing versions, ascending (a directory listing, no scan)."""
        return self._folders.numbers()

    def write(self, df: DataFrame) -> int:
        """Store the next version; it becomes visible with its record, and none is ever overwritten.

        Tables without columns are refused. Writers may run at the same time: each gets a number.
        """
        if not df.columns:
            raise DataLoadError("The table has no columns.")

        def data(folder: str) -> None:
            df.write.mode("errorifexists").parquet(f"{folder}/data")

        def record(folder: str, number: int) -> None:
            path, files = self._folders._hadoop(f"{folder}/data")
            stored = self.spark.read.parquet(f"{folder}/data")
            content_checksum(stored).select(
                F.lit(number).alias("version"), "n_rows", F.lit(len(stored.columns)).alias("n_columns"), "checksum",
                F.lit("parquet").alias("file_type"), F.lit(files.getContentSummary(path).getLength()).cast("bigint").alias("size_bytes"),
                F.lit(json.dumps(stored.schema.jsonValue())).alias("schema"), F.current_timestamp().alias("written_at"),
            ).coalesce(1).write.parquet(f"{folder}/record")

        return self._folders.add(data, record)

    def records(self) -> DataFrame:
        """One row a version, as it was written: rows, columns, checksum, file type, bytes, schema."""
        known = self.versions()
        if not known:
            raise DataLoadError(f"No version of {self.path} found.")
        return self.spark.read.parquet(*[f"{self._folders.folder(n)}/record" for n in known])

    def read(self, version: int | None = None) -> DataFrame:
        """One version, the latest by default; only its folder is read."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise DataLoadError(f"Version {version or 'latest'} of {self.path} not found.")
        return self.spark.read.parquet(f"{self._folders.folder(version or known[-1])}/data")

    def describe(self, version: int | None = None) -> DataFrame:
        """``(version, n_rows, n_columns, checksum, schema)`` of a version."""
        df = self.read(version)
        number = version or self.versions()[-1]
        return content_checksum(df).select(
            F.lit(number).alias("version"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            "checksum",
            F.lit(json.dumps(df.schema.jsonValue())).alias("schema"),
        )


def latest_versions(versions: DataFrame, key: str = "dataset_id") -> DataFrame:
    """The row with the highest version per dataset."""
    rest = [quoted(c) for c in versions.columns if c != key]
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
    return latest.select(key, "_row.*")
