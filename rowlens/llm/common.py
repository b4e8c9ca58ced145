"""Shared pieces: the shared folder, written intermediates, Arrow map steps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import new_folder, shared_dir

_WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this package has written to the shared folder, once no result is needed any more."""
    drop_folder(spark, f"{shared_dir(spark)}/rowlens")


def drop_written(df: DataFrame) -> None:
    """Delete the table that ``written`` made, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        drop_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


class temporary:
    """What is written to the shared folder within this block goes at its end, but for tables that ``keep`` wrote."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> temporary:
        self.before = set(session.folders)
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.kept.add(session.folders[-1])
        return out

    def __exit__(self, *_):
        for path in set(session.folders) - self.before - self.kept:
            drop_folder(self.spark, path)
            session.folders.remove(path)


class freed_shuffles:
    """Within this block, a finished write gives its shuffle files back at once, and Python gets rows in small batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in _WRITES}
        for k, v in _WRITES.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here,

    and a lost executor costs nothing that came before.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null has none."""
    return text_or_empty(name).cast("binary")


#: Bits of the filter that ``by_id`` broadcasts, 64 to a row.
FILTER_BITS = 1 << 24


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The left_semi or left_anti join (``how``) of ``docs`` with ``ids`` (doc_id: long, distinct), in the columns of ``docs``.

    A filter with one bit for each hash of an id is broadcast, of at most FILTER_BITS
    however many ids there are. Only rows that meet a set bit are joined with the
    ids, so no other text moves, and rows without a doc_id never do.
    """
    at = f"pmod(xxhash64(doc_id), {FILTER_BITS}L)"
    word, bit = f"shiftright({at}, 6)", f"shiftleft(1L, CAST({at} & 63 AS INT))"
    bits = ids.filter("doc_id IS NOT NULL").groupBy(F.expr(word).alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("word", F.expr(f"IF(doc_id IS NOT NULL, {word}, NULL)"))
    rows = rows.join(F.broadcast(bits), "word", "left").withColumn("met", F.expr(f"coalesce(bits & {bit}, 0L) <> 0"))
    some = rows.filter("met").select("row", "doc_id").join(ids, "doc_id", how).select("row.*")
    return some if how == "left_semi" else rows.filter("NOT met").select("row.*").unionAll(some)


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in ``column`` (one row at least)."""
    lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(lengths):
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def give_back() -> None:
    """Return free memory to the system: workers live on between stages, and executors share one limit with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)
        give_back()

    return df.mapInArrow(run, schema)
