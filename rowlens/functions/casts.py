"""Type tests, casts and normal forms of single values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of a date; the calendar is not checked.
DATE_SHAPE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4})$"
#: Fixed value: texts that count as numbers; Spark's own cast would also take '1d' or '0x1p3'.
NUMBER_SHAPE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def is_date_string(c: Column) -> Column:
    return F.coalesce(c.rlike(DATE_SHAPE), F.lit(False))


def is_date_like(c: Column, type_name: str) -> Column:
    """True for values of a date or time type, else whether the text has a date's shape."""
    return c.isNotNull() if type_name.startswith(("date", "timestamp")) else is_date_string(c.cast("string"))


def is_numeric_like(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(NUMBER_SHAPE), F.lit(False))


def coerce_numeric(c: Column, default: float | None = None) -> Column:
    """The text's number, or the default."""
    value = F.when(is_numeric_like(c), F.btrim(c, F.lit(" \t\n\r\f\x0b")).try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def safe_cast(c: Column, type_name: str) -> Column:
    """The cast value, or null."""
    return c.try_cast(type_name)


def shape_of_format(pattern: str) -> str | None:
    """A regular expression for all texts that a date format of digits reads; None for one with other letters."""
    out = ""
    for run in re.findall(r"([a-zA-Z])(\1*)|([^a-zA-Z])", pattern):
        letter, more, other = run
        if other:
            if other in "'[]#{}":
                return None
            out += re.escape(other)
        elif letter in "yMdHhmsS" and (letter != "M" or len(more) < 2):
            n = 1 + len(more)
            out += rf"\d{{1,{n}}}" if letter == "S" else r"\d+" if n == 1 else rf"[+-]?\d{{{n},}}" if letter == "y" and n > 2 else rf"\d{{{n}}}"
        else:
            return None
    return f"^{out}$"


def parse_date(c: Column, formats: tuple[str, ...]) -> Column:
    """The time that the first fitting format reads, or null.

    A parser that fails is slow, so a format is tried only where the text has its shape.
    """
    tries = []
    for f in formats:
        shape, parsed = shape_of_format(f), F.try_to_timestamp(c, F.lit(f))
        tries.append(parsed if shape is None else F.when(c.rlike(shape), parsed))
    return F.coalesce(*tries).cast("timestamp_ntz")


def normalize_date(c: Column, formats: tuple[str, ...], output: str = "yyyy-MM-dd", invalid: str = "ERROR") -> Column:
    """A date as text; what cannot be read becomes ``invalid``, a null stays null."""
    return F.when(c.isNotNull(), F.coalesce(F.date_format(parse_date(c, formats), output), F.lit(invalid)))


def normalize_number(c: Column, precision: int = 8) -> Column:
    return F.round(c, precision)


def replace_null(c: Column, replacement: str) -> Column:
    return F.coalesce(c, F.lit(replacement))
