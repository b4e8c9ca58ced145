"""Profiles: counts, cardinality and the kinds of columns, each in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import is_numeric_like, parse_date
from ..functions.equality import NUMERIC, TEMPORAL
from ..options import NormalizeOptions


def _unpivot(one: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """Rows (column_name, *parts) from a single row with columns ``i_part``."""
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{p}").alias(p) for p in parts]) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    """column_name, data_type, n_rows and n_nulls of every column."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{i}_n_nulls") for i, c in enumerate(df.columns)])
    one = one.select("*", *[F.col("n").alias(f"{i}_n_rows") for i in range(len(df.columns))], *[F.lit(df.schema[c].dataType.simpleString()).alias(f"{i}_data_type") for i, c in enumerate(df.columns)])
    return _unpivot(one, df.columns, ["data_type", "n_rows", "n_nulls"])


def cardinality(df: DataFrame, threshold: float = 0.5, approximate: bool = False) -> DataFrame:
    """column_name, n_distinct, distinct_ratio (nulls count below the line only) and low_cardinality.

    Exact distinct counts of each column are taken on their own: one aggregate
    over several of them would expand every row by their number.
    """
    if approximate:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"`{c}`").alias(f"{i}_n_distinct") for i, c in enumerate(df.columns)])
        out = _unpivot(one.select("*", *[F.col("n").alias(f"{i}_n") for i in range(len(df.columns))]), df.columns, ["n_distinct", "n"])
    else:
        out = reduce(DataFrame.unionAll, [df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("rows")).agg(F.count_if(F.col("v").isNotNull()).alias("n_distinct"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).select(F.lit(c).alias("column_name"), "n_distinct", "n") for c in df.columns])
    ratio = F.when(F.col("n") > 0, F.col("n_distinct") / F.col("n")).otherwise(F.lit(0.0))
    return out.select("column_name", "n_distinct", ratio.alias("distinct_ratio"), (ratio < threshold).alias("low_cardinality"))


def column_kinds(df: DataFrame, options: NormalizeOptions | None = None) -> DataFrame:
    """column_name, kind (date, numeric, text or empty) by type, and for texts by what all values parse as."""
    o = options or NormalizeOptions()
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    checks = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        filled = F.count(col)
        checks.append(filled.alias(f"{i}_filled"))
        if c in texts:
            checks += [F.count(parse_date(col, o.date_formats)).alias(f"{i}_dates"), F.count_if(is_numeric_like(col)).alias(f"{i}_numbers")]
    one = df.agg(*checks)
    kinds = []
    for i, c in enumerate(df.columns):
        kind, filled = df.schema[c].dataType, F.col(f"{i}_filled")
        if c in texts:
            enough = lambda n, filled=filled: n >= filled * o.detection_share
            own = F.when(filled == 0, "empty").when(enough(F.col(f"{i}_dates")), "date").when(enough(F.col(f"{i}_numbers")), "numeric").otherwise("text")
        else:
            own = F.lit("numeric" if isinstance(kind, NUMERIC) else "date" if isinstance(kind, TEMPORAL) else "text")
        kinds.append(own.alias(f"{i}_kind"))
    return _unpivot(one.select(*kinds), df.columns, ["kind"])


def detect_column_types(df: DataFrame, options: NormalizeOptions | None = None) -> dict[str, list[str]]:
    """Column names by kind: date, numeric, text. Columns without values are in none."""
    out: dict[str, list[str]] = {"date": [], "numeric": [], "text": []}
    for r in column_kinds(df, options).collect():  # a row a column
        if r.kind in out:
            out[r.kind].append(r.column_name)
    return out


def check_schema(df: DataFrame, strict: bool = False) -> list[str]:
    """What is wrong with the column names: the same name twice (in any case), or odd characters if strict."""
    import re

    low = [c.lower() for c in df.columns]
    found = [f"duplicate column {c}" for c in sorted({c for c in low if low.count(c) > 1})]
    return found + [f"invalid column name {c!r}" for c in df.columns if strict and not re.fullmatch(r"[A-Za-z0-9_]+", c)]
