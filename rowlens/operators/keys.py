"""Key sets, key reports and blocks of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .diff import key_list, with_keys


def only_in_first(t1: DataFrame, t2: DataFrame, key) -> DataFrame:
    """Distinct keys of table 1 that table 2 lacks."""
    keys = key_list(key)
    return with_keys(t1, keys).select(*keys).join(t2.select(*keys), keys, "left_anti").distinct()


def in_both(t1: DataFrame, t2: DataFrame, key) -> DataFrame:
    """Distinct keys that both tables have."""
    keys = key_list(key)
    return with_keys(t1, keys).select(*keys).join(t2.select(*keys), keys, "left_semi").distinct()


def validate_primary_key(df: DataFrame, key) -> DataFrame:
    """n_rows, null_keys, distinct_keys, duplicate_rows and is_valid of a key, in one pass."""
    keys = key_list(key)
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("whole", whole)
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"), F.count_if("whole").alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col("whole"), F.col("n") - 1).otherwise(0)), F.lit(0)).alias("duplicate_rows"))
    return out.withColumn("is_valid", (F.col("null_keys") == 0) & (F.col("duplicate_rows") == 0))


def with_positions(df: DataFrame) -> DataFrame:
    """Adds ``position``, the row's place from 0, to rows that are in order from partition to partition.

    Each partition counts by itself and starts at the sum of those before it; only
    one row a partition meets the others. The rows are written first: bounds of a
    sort are sampled, so counting and numbering must see the same partitions, also
    after the loss of an executor.
    """
    own = stored(df.withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()), "positions")
    sizes = own.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).drop("n")
    return own.join(F.broadcast(starts), "p").withColumn("position", F.col("m") - F.col("first") + F.col("before")).drop("p", "m", "first", "before")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``, the row's place from 0 in the given order."""
    return with_positions(df.repartitionByRange(*order).sortWithinPartitions(*order))


def chunk_assignment(df: DataFrame, key, chunk_size: int = 10_000) -> DataFrame:
    """Adds ``chunk``: blocks of ``chunk_size`` rows in the order of the key."""
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    return numbered(df, key_list(key)).withColumn("chunk", F.floor(F.col("position") / chunk_size).cast("long")).drop("position")


def chunk_key_ranges(df: DataFrame, key, chunk_size: int = 10_000) -> DataFrame:
    """chunk, n_rows, and the smallest and largest value of each key column in it."""
    keys = key_list(key)
    ranges = [f(k).alias(f"{n}_{k}") for k in keys for n, f in (("min", F.min), ("max", F.max))]
    return chunk_assignment(df.select(*keys), keys, chunk_size).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), *ranges)


def between(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie within the ranges, both ends included."""
    for c, (lo, hi) in ranges.items():
        df = df.filter(F.col(c).between(lo, hi))
    return df
