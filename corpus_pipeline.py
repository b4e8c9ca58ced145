"""A corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm import bpe, common, decontaminate, near_dedup, suffix_dedup, toxicity
from rowlens.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scorer(model)(F.coalesce(F.col("text"), F.lit("")))["score"] < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    Of rows that share a doc_id one stays; rows without one all stay. Only the ids
    that go or repeat are left of the search when texts are read again, and only
    texts that may have such an id move.
    """
    ship(spark)
    with common.temporary(spark) as own:
        ids = near_dedup.groups(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        ids = own.keep(ids.filter("NOT kept OR n > 1"), "copies")
    left = common.by_id(docs, ids.select("doc_id"), "left_anti")
    repeated = ids.filter("kept").select("doc_id")
    if not repeated.limit(1).count():
        return left
    once = common.by_id(docs, repeated, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.unionByName(once)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that occur earlier; n_chars follows the text.

    Where a cut falls inside a character, the rest of that character goes too.
    A null text stays null, and a document of which nothing is left stays, empty.
    """
    ship(spark)
    out = suffix_dedup.remove(docs)
    out = out.withColumn("new_text", F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text")))
    own = {"text": F.col("new_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("new_text").cast("long"))}
    return out.select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and checksums of the ids and of what they decode to."""
    ship(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]

#: Scores of a fitted model have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again.

    What a stage has written on its way goes when it ends, and its result when the
    next one has been written: at the end only that of the last stage is left.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with common.temporary(spark) as own:
            docs = own.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.drop_written(before)
        before = docs
    return docs
