"""Words and word k-grams as DataFrame expressions: nothing here runs Python on the executors.

Explode such arrays with the outer variants: for the others the optimizer infers
a filter on the array's size, into which it copies the whole expression, and the
words would be split again for every element.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words: every ASCII character but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z (and no other letter) in lower case; a null has none."""
    small = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(small, BETWEEN), "")


def grams(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words of an array column, by position; none if it is shorter."""
    w = F.col(words)
    run = lambda i: F.xxhash64(F.lit(k), *[w[i + j] for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), run)).otherwise(F.array().cast("array<bigint>"))


def row_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes, k1 and k2, that tell rows apart by what they hold; nulls count."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"k{seed}") for seed in (1, 2)]
