"""Functions on texts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .equality import WHITESPACE


def normalize_column_name(c: Column) -> Column:
    """Lower case, special characters to underscores, runs of them to one, none at the ends; spaces stay."""
    c = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "_")
    return F.btrim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def clean_string(c: Column) -> Column:
    """Special characters to spaces, white space to one space, trimmed, lower case."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")
    return F.lower(F.btrim(c, F.lit(WHITESPACE)))


def normalize_field_name(c: Column, case_sensitive: bool = False, ignore_whitespace: bool = True) -> Column:
    """A field name as names are matched by: case, a final _id, separators, camel case, white space."""
    if not case_sensitive:
        c = F.lower(c)
    c = F.regexp_replace(F.regexp_replace(c, "_id$", "id"), r"[-_\s]", " ")
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(c, r"\s+", "") if ignore_whitespace else c


def overlap_score(a: Column, b: Column) -> Column:
    """Share of common tokens between underscores; two empty texts share their one empty token."""
    x, y = F.split(F.lower(a), "_"), F.split(F.lower(b), "_")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def normalize_text(c: Column, case: str = "lower", trim: bool = True, strip_special_chars: bool = True) -> Column:
    """Special characters to spaces and runs of white space to one, trimmed, and put into one case."""
    if strip_special_chars:
        c = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")
    if trim:
        c = F.btrim(c, F.lit(WHITESPACE))
    return {"lower": F.lower, "upper": F.upper}.get(case, lambda x: x)(c)
