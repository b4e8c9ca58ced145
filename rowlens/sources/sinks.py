"""Where results go: tables of differences, summaries, reports and logs."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import by_type_and_field, summarize
from .xlsx import write_xlsx

#: Colours of a report's rows by difference type.
COLOURS = {"missing": "FFC7CE", "added": "C6EFCE", "changed": "FFEB9C"}
#: An Excel sheet has no more rows than this (a fixed value of the format).
SHEET_ROWS = 1_048_575


def write_differences(differences: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by_type: bool = False) -> None:
    """The differences as parquet, csv, json or orc, written by all executors."""
    if fmt not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {fmt!r}")
    w = differences.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by_type:
        w = w.partitionBy("difference_type")
    w.save(path)


def generate_report(differences: DataFrame, path: str, rows: int = SHEET_ROWS) -> dict:
    """An Excel report with a summary and a differences sheet; returns the summary.

    A sheet cannot hold more than ``rows`` rows: what is left out is counted on
    the summary sheet, and ``write_differences`` writes all of them.
    """
    total = summarize(differences)
    taken = [[x if x is None or isinstance(x, (int, float, str, bool)) else str(x) for x in r] for r in differences.limit(rows).toLocalIterator()]
    head = [["metric", "value"], ["total differences", total["total_differences"]], *[[f"{k} cells", n] for k, n in total["by_type"].items()], *[[f"in {k}", n] for k, n in total["by_field"].items()], ["not on the differences sheet", total["total_differences"] - len(taken)]]
    keys = differences.columns.index("field_name")
    write_xlsx(path, {"Summary": head, "Differences": [differences.columns, *taken]}, frozen_columns=min(keys, 20), highlight=COLOURS)
    return total


def create_summary(differences: DataFrame) -> DataFrame:
    return by_type_and_field(differences).orderBy("difference_type", "field_name")


def json_lines(differences: DataFrame) -> DataFrame:
    """One JSON text a difference."""
    return differences.select(F.to_json(F.struct("*")).alias("value"))


class JsonLog(logging.Handler):
    """Log entries as JSON lines {timestamp, level, message, context}."""

    def __init__(self, path: str):
        super().__init__()
        self.file = open(path, "a", encoding="utf-8")

    def emit(self, record: logging.LogRecord) -> None:
        entry = {"timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "message": record.getMessage(), "context": getattr(record, "context", {})}
        self.file.write(json.dumps(entry) + "\n")
        self.file.flush()

    def close(self) -> None:
        self.file.close()
        super().close()
