"""Summaries of differences, and metrics of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff import ADDED, CHANGED, MISSING


def by_type(differences: DataFrame) -> DataFrame:
    """difference_type and n, with all three types (zero where there are none)."""
    spark = differences.sparkSession
    kinds = spark.sql(f"SELECT * FROM VALUES ('{MISSING}'), ('{ADDED}'), ('{CHANGED}') AS k(difference_type)")
    counts = differences.groupBy("difference_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "difference_type", "left").select("difference_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_field(differences: DataFrame) -> DataFrame:
    return differences.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"))


def by_type_and_field(differences: DataFrame) -> DataFrame:
    return differences.groupBy("difference_type", "field_name").agg(F.count(F.lit(1)).alias("n"))


def rate(differences: DataFrame, t1: DataFrame) -> DataFrame:
    """total_rows of table 1, total_differences (cells) and difference_rate in percent (0 without rows)."""
    rows = t1.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(0).cast("long").alias("total_differences"))
    cells = differences.agg(F.lit(0).cast("long").alias("total_rows"), F.count(F.lit(1)).alias("total_differences"))
    out = rows.unionAll(cells).agg(F.sum("total_rows").alias("total_rows"), F.sum("total_differences").alias("total_differences"))
    return out.withColumn("difference_rate", F.when(F.col("total_rows") > 0, F.col("total_differences") / F.col("total_rows") * 100).otherwise(F.lit(0.0)))


def rows_with_differences(rows: DataFrame) -> DataFrame:
    """Counts of missing, added, changed and equal rows from ``row_differences``."""
    changed = (F.col("row_status") == "common") & (F.col("changed_cells") > 0)
    return rows.agg(F.count_if(F.col("row_status") == MISSING).alias("missing_rows"), F.count_if(F.col("row_status") == ADDED).alias("added_rows"), F.count_if(changed).alias("changed_rows"), F.count_if((F.col("row_status") == "common") & (F.col("changed_cells") == 0)).alias("equal_rows"))


def summarize(differences: DataFrame) -> dict:
    """total, by_type (all three) and by_field, in one job over the differences."""
    counts = {(r.difference_type, r.field_name): r.n for r in by_type_and_field(differences).collect()}  # a few rows a column
    kinds = {k: sum(n for (t, _), n in counts.items() if t == k) for k in (MISSING, ADDED, CHANGED)}
    fields: dict[str, int] = {}
    for (_, f), n in sorted(counts.items()):
        fields[f] = fields.get(f, 0) + n
    return {"total_differences": sum(counts.values()), "by_type": kinds, "by_field": fields}


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def processing_rate(rows: int, seconds: float) -> float:
    """Rows a second; 0 without a duration."""
    return rows / seconds if seconds > 0 else 0.0
