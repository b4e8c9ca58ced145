"""Comparing two tables from end to end."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..errors import ComparisonError
from ..operators import diff, match, normalize, summary
from ..options import CompareOptions, MatchOptions, NormalizeOptions, ValidationOptions

log = logging.getLogger("rowlens")


@dataclass
class ComparisonResult:
    """Differences (lazy) and, counted when asked for, their summary."""

    differences: DataFrame
    rows: DataFrame
    table1: DataFrame
    mapping: dict[str, str]
    primary_key: list[str]
    comparison_timestamp: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    _summary: dict | None = None

    @property
    def summary(self) -> dict:
        """Counts by type and field, rows, rates; the differences are computed once for it."""
        if self._summary is None:
            began = time.time()
            out = summary.summarize(self.differences)
            total = self.table1.count()
            status = summary.rows_with_differences(self.rows).first().asDict()
            out |= {"total_rows": total, "difference_rate": out["total_differences"] / total * 100 if total else 0.0, "rows_with_differences": status["missing_rows"] + status["added_rows"] + status["changed_rows"], **status, "comparison_timestamp": self.comparison_timestamp.isoformat()}
            out["processing_rate"] = summary.processing_rate(total, time.time() - began)
            self._summary = out
        return self._summary

    @property
    def difference_rate(self) -> float:
        """Differing cells per hundred rows of table 1."""
        return self.summary["difference_rate"]

    def ordered(self) -> DataFrame:
        return diff.ordered(self.differences, self.primary_key)


def warn_if_large(*tables: DataFrame, limit_mb: int = 500) -> int:
    """The estimated size in MB of the tables; a log warning above the limit."""
    mb = sum(summary.estimated_bytes(t) for t in tables) >> 20
    if mb > limit_mb:
        log.warning("the tables are estimated at %d MB", mb)
    return mb


def check_tables(table1: DataFrame, table2: DataFrame, primary_key, field_mapping: dict[str, str] | None = None, options: ValidationOptions | None = None, match_options: MatchOptions | None = None) -> list[str]:
    """What speaks against comparing two tables; empty if nothing does.

    Names and types come from the schemas; only the look for duplicate keys runs
    over the data, one aggregation a table.
    """
    o = options or ValidationOptions()
    keys = diff.key_list(primary_key)
    mapping = field_mapping if field_mapping is not None else match.match_fields(table1.columns, table2.columns, keys, match_options).matched
    mapping = {**{k: k for k in keys}, **mapping}
    present = {a: b for a, b in mapping.items() if a in table1.columns and b in table2.columns}
    alone1 = sorted(set(table1.columns) - set(present))
    alone2 = sorted(set(table2.columns) - set(present.values()))
    out = [f"key column {k} is not in both tables" for k in keys if k not in present]
    if not o.allow_missing_columns:
        out += [f"table {n} alone has column {c}" for n, names in ((1, alone1), (2, alone2)) for c in names]
    share = len(present) / len(table1.columns) if table1.columns else 0.0
    if share < o.schema_match_threshold:
        out.append(f"{share:.0%} of the columns match, {o.schema_match_threshold:.0%} are needed")
    if o.strict_schema_check:
        kinds1, kinds2 = dict(table1.dtypes), dict(table2.dtypes)
        out += [f"column {a} is {kinds1[a]} in table 1 and {kinds2[b]} in table 2" for a, b in present.items() if kinds1[a] != kinds2[b]]
    if o.require_unique_keys and all(k in present for k in keys):
        for n, table, own in ((1, table1, keys), (2, table2, [present[k] for k in keys])):
            if not diff.duplicate_keys(table, own).isEmpty():
                out.append(f"keys of table {n} are not unique")
    return out


def compare_tables(table1: DataFrame, table2: DataFrame, primary_key, field_mapping: dict[str, str] | None = None, options: CompareOptions | None = None, match_options: MatchOptions | None = None, normalize_options: NormalizeOptions | None = None) -> ComparisonResult:
    """Normalise, match columns unless a mapping is given, and compare.

    Texts are normalised first (switch off with ``normalize_before_compare``);
    times keep their type, so that their precision matters. Keys are not
    normalised. Raises ComparisonError for empty tables, missing columns and
    keys that are not unique.
    """
    o = options or CompareOptions()
    keys = diff.key_list(primary_key)
    for name, t in (("table 1", table1), ("table 2", table2)):
        if not isinstance(t, DataFrame):
            raise TypeError(f"{name} is not a DataFrame")
        if t.isEmpty():
            raise ComparisonError(f"{name} is empty")
    lost = sorted(set(keys) - set(table1.columns))
    if lost:
        raise ComparisonError(f"key columns not in table 1: {', '.join(lost)}")
    if field_mapping is None:
        field_mapping = match.match_fields(table1.columns, table2.columns, keys, match_options).matched
    unmatched = [k for k in keys if field_mapping.get(k, k) not in table2.columns]
    if unmatched:
        raise ComparisonError(f"key columns without a match in table 2: {', '.join(unmatched)}")
    if o.normalize_before_compare:
        plain = normalize_options or NormalizeOptions(case="preserve" if o.case_sensitive else "lower")
        table1 = _normalized(table1, keys, plain)
        table2 = _normalized(table2, [field_mapping.get(k, k) for k in keys], plain)
    joined = diff.join(table1, table2, keys, field_mapping, o)
    return ComparisonResult(diff.cells(joined), diff.row_differences(joined), table1, field_mapping, keys)


def _normalized(df: DataFrame, keys: list[str], options: NormalizeOptions) -> DataFrame:
    """Texts and floating numbers in normal form, by type alone: no pass over the data."""
    kinds = dict(df.dtypes)
    texts = [c for c, k in kinds.items() if k.startswith(("string", "varchar", "char")) and c not in keys]
    numbers = [c for c, k in kinds.items() if k in ("float", "double") and c not in keys]
    return normalize.normalize_table(df, None, numbers, texts, options) if texts or numbers else df


class DataProcessor:
    """The three operations with common options."""

    def __init__(self, options: CompareOptions | None = None, match_options: MatchOptions | None = None, normalize_options: NormalizeOptions | None = None):
        self.options, self.match_options, self.normalize_options = options or CompareOptions(), match_options or MatchOptions(), normalize_options or NormalizeOptions()

    def normalize_table(self, df: DataFrame, date_columns=None, numeric_columns=None, text_columns=None, **changes) -> DataFrame:
        return normalize.normalize_table(df, date_columns, numeric_columns, text_columns, self.normalize_options.with_changes(**changes))

    def match_fields(self, fields1: list[str], fields2: list[str], primary_key=None, **changes) -> match.MatchResult:
        return match.match_fields(fields1, fields2, primary_key, self.match_options.with_changes(**changes))

    def compare_tables(self, table1: DataFrame, table2: DataFrame, primary_key, field_mapping=None, **changes) -> ComparisonResult:
        options = self.options.with_changes(**changes)
        warn_if_large(table1, table2, limit_mb=options.memory_warning_mb)
        return compare_tables(table1, table2, primary_key, field_mapping, options, self.match_options, self.normalize_options)
