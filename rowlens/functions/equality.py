"""Equality of values and what is known about a pair of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import CompareOptions

#: What is stripped from both ends of a text.
WHITESPACE = " \t\n\r\f\x0b"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = (*INTEGRAL, *FLOATING, T.DecimalType, T.BooleanType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.CharType, T.VarcharType)


def without_nan(c: Column, kind: T.DataType) -> Column:
    """NaN counts as null."""
    return F.when(~F.isnan(c), c) if isinstance(kind, FLOATING) else c


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as text; nested values as JSON."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c if isinstance(kind, TEXT) else c.cast("string")


def sql_text(name: str, kind: T.DataType, nan_is_null: bool = False) -> str:
    """``as_text`` of a column as SQL; NaN may count as null."""
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    text = f"to_json({name})" if nested else name if isinstance(kind, TEXT) else f"CAST({name} AS STRING)"
    return f"CASE WHEN NOT isnan({name}) THEN {text} END" if nan_is_null and isinstance(kind, FLOATING) else text


def as_number(c: Column, kind: T.DataType) -> Column:
    return c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else c.cast("double")


def as_time(c: Column, kind: T.DataType) -> Column:
    """A temporal value, or a text that reads as one, as a timestamp without time zone; else null."""
    return c.cast("timestamp_ntz") if isinstance(kind, TEMPORAL) else c.try_cast("timestamp_ntz")


def text_key(c: Column, options: CompareOptions) -> Column:
    """What texts are compared by."""
    if options.ignore_whitespace:
        c = F.btrim(c, F.lit(WHITESPACE))
    return c if options.case_sensitive else F.lower(c)


def text_equal(a: Column, b: Column, options: CompareOptions) -> Column:
    return text_key(a, options) == text_key(b, options)


def numbers_equal(a: Column, b: Column, options: CompareOptions) -> Column:
    """Within the tolerance relative to the second value; infinities only by themselves; null beside a null."""
    size = F.abs(b)  # an infinite first value is never within the tolerance of a finite one
    same = (a == b) if options.inf_equality else (a == b) & F.lit(False)
    return F.when(size == float("inf"), same).otherwise(F.abs(a - b) <= size * options.float_tolerance)


def times_equal(a: Column, b: Column, precision: str) -> Column:
    """Equal after cutting both at a unit."""
    return F.date_trunc(precision, a) == F.date_trunc(precision, b)


def similar_numbers(a: Column, b: Column, tolerance: float = 1e-8, absolute: float = 1e-8) -> Column:
    """Within an absolute plus a relative tolerance."""
    return F.abs(a.cast("double") - b.cast("double")) <= F.lit(absolute) + F.lit(tolerance) * F.abs(b.cast("double"))


def values_equal(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType, options: CompareOptions | None = None) -> Column:
    """Whether two values are equal, never null. The rule is chosen from the two types.

    Nulls (NaN counts) come first; then numbers by tolerance, times by
    precision, texts by their key, everything else exactly. A number and a text
    are compared as texts, or are unequal if that is switched off.
    """
    o = options or CompareOptions()
    a, b = without_nan(a, kind_a), without_nan(b, kind_b)
    is_a = lambda *kinds: isinstance(kind_a, kinds)
    is_b = lambda *kinds: isinstance(kind_b, kinds)
    as_texts = lambda: text_equal(as_text(a, kind_a), as_text(b, kind_b), o)
    never = False
    if is_a(T.NullType) or is_b(T.NullType):
        never = True
    elif o.exact_match_only:
        if is_a(*NUMERIC) and is_b(*NUMERIC):
            equal = (a == b) if type(kind_a) is type(kind_b) else as_number(a, kind_a) == as_number(b, kind_b)
        elif is_a(*TEMPORAL) and is_b(*TEMPORAL):
            equal = as_time(a, kind_a) == as_time(b, kind_b)
        else:
            never = type(kind_a) is not type(kind_b)
            equal = as_text(a, kind_a) == as_text(b, kind_b)
    elif is_a(*NUMERIC) and is_b(*NUMERIC):
        whole = (*INTEGRAL, T.BooleanType) if o.exact_integers else (T.BooleanType,)
        equal = as_number(a, kind_a) == as_number(b, kind_b) if is_a(T.BooleanType) or is_b(T.BooleanType) else a == b if is_a(*whole) and is_b(*whole) else numbers_equal(as_number(a, kind_a), as_number(b, kind_b), o)
    elif is_a(*NUMERIC) or is_b(*NUMERIC):
        never = not o.ignore_string_type_mismatch
        equal = as_texts()
    elif (is_a(*TEMPORAL) and is_b(*TEMPORAL, *TEXT)) or (is_b(*TEMPORAL) and is_a(*TEXT)):
        x, y = as_time(a, kind_a), as_time(b, kind_b)
        equal = times_equal(x, y, o.date_precision)
        if not (is_a(*TEMPORAL) and is_b(*TEMPORAL)):
            equal = F.when(x.isNull() | y.isNull(), as_texts()).otherwise(equal)
    elif is_a(*TEXT) or is_b(*TEXT):
        equal = as_texts()
    else:
        equal = as_text(a, kind_a) == as_text(b, kind_b)
    if never:
        return a.isNull() & b.isNull() if o.null_equality else F.lit(False)
    # beside a null every rule gives null, or false; what is null for other reasons is unequal
    return F.coalesce(equal, a.isNull() & b.isNull() if o.null_equality else F.lit(False))


def percentage_difference(a: Column, b: Column) -> Column:
    """0 if equal, infinite from 0, else the change in percent of the first value."""
    return F.when(a == b, F.lit(0.0)).when(a == 0, F.lit(float("inf"))).otherwise(F.abs((b - a) / F.when(a != 0, a)) * 100)


def seconds_between(a: Column, b: Column) -> Column:
    """Signed seconds from the second time to the first, with fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(a) - micros(b)) / F.lit(1e6)


def measures(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType) -> dict[str, Column]:
    """What two types allow to be measured: absolute and percentage difference, edit distance, or seconds."""
    a, b = without_nan(a, kind_a), without_nan(b, kind_b)
    both = lambda *kinds: isinstance(kind_a, kinds) and isinstance(kind_b, kinds)
    if both(*NUMERIC):
        x, y = as_number(a, kind_a), as_number(b, kind_b)
        return {"absolute_difference": F.abs(x - y), "percentage_difference": percentage_difference(x, y)}
    if both(*TEMPORAL):
        return {"time_difference_seconds": seconds_between(as_time(a, kind_a), as_time(b, kind_b))}
    return {"levenshtein_distance": F.levenshtein(a, b).cast("int")} if both(*TEXT) else {}


def difference_details(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType) -> dict[str, Column]:
    """message, types, and what the types allow: absolute, percentage, edit distance, seconds."""
    null = F.lit(None).cast("double")
    x, y = without_nan(a, kind_a), without_nan(b, kind_b)
    return {
        "message": F.when(x.isNull() != y.isNull(), "one side is null").otherwise("values differ"),
        "type1": F.lit(kind_a.simpleString()),
        "type2": F.lit(kind_b.simpleString()),
        "absolute_difference": null,
        "percentage_difference": null,
        "levenshtein_distance": F.lit(None).cast("int"),
        "time_difference_seconds": null,
    } | measures(a, b, kind_a, kind_b)


def comparison_info(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType, options: CompareOptions | None = None) -> dict[str, Column]:
    """equal, types, null flags, and the details of the pair's kind."""
    a1, b1 = without_nan(a, kind_a), without_nan(b, kind_b)
    out = {"equal": values_equal(a, b, kind_a, kind_b, options), "type1": F.lit(kind_a.simpleString()), "type2": F.lit(kind_b.simpleString()), "null1": a1.isNull(), "null2": b1.isNull()}
    if isinstance(kind_a, NUMERIC) and isinstance(kind_b, NUMERIC):
        x, y = as_number(a1, kind_a), as_number(b1, kind_b)
        out |= {"absolute_difference": F.abs(x - y), "percentage_difference": percentage_difference(x, y)}
    elif isinstance(kind_a, TEMPORAL) and isinstance(kind_b, TEMPORAL):
        out |= {"time_difference_seconds": seconds_between(as_time(a1, kind_a), as_time(b1, kind_b))}
    elif isinstance(kind_a, TEXT) and isinstance(kind_b, TEXT):
        out |= {"length_difference": F.char_length(a1) - F.char_length(b1), "case_difference": (F.lower(a1) == F.lower(b1)) & (a1 != b1)}
    return out
