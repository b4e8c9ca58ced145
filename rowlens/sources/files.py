"""Reading CSV and Excel files, in whole or in blocks, and their profile."""

from __future__ import annotations

import codecs
import csv
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FileMissing, InvalidFormat, InvalidStructure
from ..options import NA_TOKENS, ReadOptions
from . import xlsx
from .encoding import detect_encoding

FORMATS = (".csv", ".xlsx", ".xls")
#: Encodings that Spark's CSV reader takes; others are converted first.
SPARK_CHARSETS = {"utf-8": "UTF-8", "ascii": "UTF-8", "iso8859-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32": "UTF-32"}


def supported_formats() -> list[str]:
    return list(FORMATS)


@dataclass
class ParsedData:
    """A file as a table, and its profile."""

    data: DataFrame
    sheet_name: str | None
    total_rows: int
    total_columns: int
    column_types: dict[str, str]
    null_counts: dict[str, int]


def _is_local(path: str) -> bool:
    return "://" not in path


def header(path: str, encoding: str, delimiter: str = ",") -> list[str]:
    """The first line's names, without reading the rest."""
    with open(path, encoding=encoding, newline="") as f:
        return next(csv.reader(f, delimiter=delimiter), [])


def _charset(path: str, encoding: str) -> tuple[str, str]:
    """Path and charset that Spark can read: the file itself, or a converted copy."""
    name = codecs.lookup(encoding).name.removesuffix("-sig")
    if name in SPARK_CHARSETS:
        return path, SPARK_CHARSETS[name]
    from .encoding import convert_encoding

    return convert_encoding(path, "utf-8", encoding), "UTF-8"


def read_csv(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """A CSV file with a header. Missing-value tokens become null before types are inferred.

    The encoding of a local file is detected; folders and remote paths are in
    UTF-8 unless one is named. UTF-8 and ISO-8859-1 files are split; UTF-16 and UTF-32 are read whole, as
    splitting would cut their line ends.
    """
    o = options or ReadOptions()
    charset = SPARK_CHARSETS.get(codecs.lookup(o.encoding).name, o.encoding) if o.encoding else "UTF-8"
    if _is_local(path) and not os.path.exists(path):
        raise FileMissing(f"no such file: {path}", path=path)
    if _is_local(path) and os.path.isfile(path):
        encoding = o.encoding or detect_encoding(path).encoding
        names = header(path, encoding, o.delimiter)
        if not names:
            raise InvalidStructure(f"the file is empty: {path}", path=path)
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise InvalidStructure(f"columns occur twice: {', '.join(twice)}", path=path, columns=twice)
        path, charset = _charset(path, encoding)
    reader = spark.read.option("header", True).option("sep", o.delimiter).option("encoding", charset).option("escape", '"')
    if charset.startswith(("UTF-16", "UTF-32")):
        reader = reader.option("multiLine", True)
    if o.schema is not None:
        df = reader.schema(o.schema).csv(path)
    else:
        df = reader.csv(path)
    tokens = [*NA_TOKENS, *o.na_values]
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    df = df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(tokens), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
    if o.schema is None and o.infer_schema:
        df = with_inferred_types(df, set(o.parse_dates))
    if o.parse_dates:
        read = lambda c: F.try_to_timestamp(c.cast("string"), F.lit(o.date_format)) if o.date_format else c.try_cast("timestamp")
        df = df.select(*[read(F.col(f"`{c}`")).cast("timestamp_ntz").alias(c) if c in o.parse_dates else F.col(f"`{c}`") for c in df.columns])
    return df


def with_inferred_types(df: DataFrame, keep: set[str] = frozenset()) -> DataFrame:
    """Text columns whose every value reads as bigint, double or boolean, as that; one pass over the data."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not names:
        return df
    checks = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        checks += [F.count(col).alias(f"n{i}"), F.count(F.when(col.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(col).try_cast("bigint"))).alias(f"long{i}"), F.count(F.when(F.lower(col).rlike(r"^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf)\s*$"), F.trim(col).try_cast("double"))).alias(f"double{i}"), F.count_if(F.lower(F.trim(col)).isin("true", "false")).alias(f"boolean{i}")]
    found = df.agg(*checks).first()
    kinds = {c: next((k for k, t in (("bigint", "long"), ("double", "double"), ("boolean", "boolean")) if found[f"n{i}"] and found[f"{t}{i}"] == found[f"n{i}"]), "string") for i, c in enumerate(names)}
    return df.select(*[F.trim(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns])


def read_file(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """A table from a file by its suffix."""
    o = options or ReadOptions()
    if _is_local(path) and not os.path.exists(path):
        raise FileMissing(f"no such file: {path}", path=path)
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path, o)
    if suffix in (".xlsx", ".xls"):
        return xlsx.read_xlsx(spark, path, o.sheet_name, o.na_values)
    raise InvalidFormat(f"files of type {suffix or 'none'} are not read: {path}", path=path, supported=list(FORMATS))


def parse_file(spark: SparkSession, path: str, options: ReadOptions | None = None) -> ParsedData:
    """A table with its counts of rows, columns and nulls, which one aggregate gives."""
    o = options or ReadOptions()
    df = read_file(spark, path, o)
    sheet = None if path.lower().endswith(".csv") else o.sheet_name or xlsx.sheet_names(path)[0]
    counts = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]).first()
    return ParsedData(df, sheet, counts[0], len(df.columns), dict(df.dtypes), dict(zip(df.columns, counts[1:], strict=True)))


def chunks(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """The rows in blocks of ``size``, one partition after the other; the driver holds one block and one partition."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while block := list(itertools.islice(rows, size)):
        yield pd.DataFrame.from_records(block, columns=df.columns)


def read_chunks(spark: SparkSession, path: str, chunk_size: int = 10_000, options: ReadOptions | None = None) -> Iterator[pd.DataFrame]:
    """The rows of a file in blocks; the size in ``options`` goes before ``chunk_size``."""
    o = options or ReadOptions(chunk_size=chunk_size)
    return chunks(read_file(spark, path, o), o.chunk_size)


sheet_names = xlsx.sheet_names
