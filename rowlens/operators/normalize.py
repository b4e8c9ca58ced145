"""Normalising a table: one projection of column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NormalizationError
from ..functions import casts, text
from ..functions.equality import NUMERIC, TEMPORAL, TEXT
from ..options import NormalizeOptions
from .profile import check_schema, detect_column_types


def normalize_table(df: DataFrame, date_columns: list[str] | None = None, numeric_columns: list[str] | None = None, text_columns: list[str] | None = None, options: NormalizeOptions | None = None, dates_as_text: bool = True) -> DataFrame:
    """Dates as text, numbers rounded, texts cleaned; other columns stay.

    Without any list (an empty one counts as none) the kinds are found from types
    and values. ``dates_as_text=False`` leaves dates and times as they are.
    """
    o = options or NormalizeOptions()
    faults = check_schema(df)
    if faults:
        raise NormalizationError("; ".join(faults))
    lost = sorted({*(date_columns or ()), *(numeric_columns or ()), *(text_columns or ())} - set(df.columns))
    if lost:
        raise NormalizationError(f"columns not in the table: {', '.join(lost)}")
    if not (date_columns or numeric_columns or text_columns):
        found = detect_column_types(df, o)
        date_columns, numeric_columns, text_columns = found["date"], found["numeric"], found["text"]
    out = []
    for c in df.columns:
        col, kind = F.col(f"`{c}`"), df.schema[c].dataType
        if c in (date_columns or ()):
            if dates_as_text:
                col = F.date_format(col, o.date_output) if isinstance(kind, TEMPORAL) else casts.normalize_date(col.cast("string"), o.date_formats, o.date_output, o.invalid_date)
        elif c in (numeric_columns or ()):
            number = col.cast("double") if isinstance(kind, NUMERIC) else casts.coerce_numeric(col.cast("string"))
            col = casts.normalize_number(number, o.numeric_precision)
        elif c in (text_columns or ()) and isinstance(kind, TEXT):
            col = text.normalize_text(col, o.case, o.trim, o.strip_special_chars)
            if o.replace_nulls:
                col = casts.replace_null(col, o.null_replacement)
        out.append(col.alias(c))
    return df.select(*out)
