"""Options of comparing, matching, normalising and reading."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column


class DatePrecision(str, Enum):
    YEAR, MONTH, DAY, HOUR, MINUTE, SECOND = "year", "month", "day", "hour", "minute", "second"


class StringCase(str, Enum):
    LOWER, UPPER, PRESERVE = "lower", "upper", "preserve"


class _Options:
    def with_changes(self, **changes):
        """A copy with other values; names that are no option are an error."""
        return replace(self, **changes)


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class CompareOptions(_Options):
    """What counts as equal, and which columns are compared."""

    float_tolerance: float = 1e-8
    date_precision: str = "second"
    case_sensitive: bool = False
    ignore_whitespace: bool = True
    null_equality: bool = True
    inf_equality: bool = True
    exact_match_only: bool = False
    ignore_string_type_mismatch: bool = True
    exact_integers: bool = True
    ignore_columns: tuple[str, ...] = ()
    column_aliases: dict[str, str] = field(default_factory=dict)
    #: "eager" looks for duplicate keys before comparing, "lazy" while comparing, "off" not at all.
    unique_keys: str = "eager"
    normalize_before_compare: bool = True
    #: Equality of a column by name instead of that of its types.
    comparators: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)
    #: A hint only: Spark's partitions take the place of chunks.
    chunk_size: int = 10_000
    memory_warning_mb: int = 500

    def __post_init__(self):
        _require(self.float_tolerance >= 0, "float_tolerance must not be negative")
        _require(self.date_precision in {p.value for p in DatePrecision}, f"unknown date_precision {self.date_precision!r}")
        _require(self.unique_keys in ("eager", "lazy", "off"), f"unknown unique_keys {self.unique_keys!r}")
        _require(self.chunk_size > 0, "chunk_size must be positive")
        _require(self.memory_warning_mb > 0, "memory_warning_mb must be positive")


@dataclass(frozen=True)
class MatchOptions(_Options):
    """How column names are matched. Weights and word lists are fixed values of the scoring."""

    similarity_threshold: float = 0.85
    case_sensitive: bool = False
    ignore_whitespace: bool = True
    suggestion_share: float = 0.8
    relaxed_share: float = 0.7
    common_word_weight: float = 0.15
    prefix_weight: float = 0.1
    suffix_weight: float = 0.1
    acronym_weight: float = 0.2
    prefixes: frozenset[str] = frozenset(("customer", "user", "product", "order", "transaction"))
    suffixes: frozenset[str] = frozenset(("id", "code", "num", "number", "date", "amount"))

    def __post_init__(self):
        _require(0 <= self.similarity_threshold <= 1, "similarity_threshold must lie between 0 and 1")


@dataclass(frozen=True)
class NormalizeOptions(_Options):
    """How columns are normalised."""

    date_formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")
    date_output: str = "yyyy-MM-dd"
    invalid_date: str = "ERROR"
    numeric_precision: int = 8
    case: str = "lower"
    trim: bool = True
    strip_special_chars: bool = True
    replace_nulls: bool = False
    null_replacement: str = ""
    #: Share of the non-null values that must parse for a text column to count as dates or numbers.
    detection_share: float = 1.0

    def __post_init__(self):
        _require(self.case in {c.value for c in StringCase}, f"unknown case {self.case!r}")
        _require(self.numeric_precision >= 0, "numeric_precision must not be negative")
        _require(0 < self.detection_share <= 1, "detection_share must lie between 0 and 1")
        _require(bool(self.date_formats), "at least one date format is needed")


@dataclass(frozen=True)
class ValidationOptions(_Options):
    """What two tables must fulfil before they are compared."""

    require_unique_keys: bool = True
    allow_missing_columns: bool = False
    strict_schema_check: bool = True
    #: Share of table 1's columns that need a partner in table 2.
    schema_match_threshold: float = 0.8

    def __post_init__(self):
        _require(0 <= self.schema_match_threshold <= 1, "schema_match_threshold must lie between 0 and 1")


#: Tokens read as missing besides the user's own (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class ReadOptions(_Options):
    """How files are read."""

    encoding: str | None = None
    sheet_name: str | None = None
    chunk_size: int = 10_000
    na_values: tuple[str, ...] = ()
    parse_dates: tuple[str, ...] = ()
    date_format: str | None = None
    delimiter: str = ","
    infer_schema: bool = True
    schema: object = None

    def __post_init__(self):
        _require(self.chunk_size > 0, "chunk_size must be positive")
